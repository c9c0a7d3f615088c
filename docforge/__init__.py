"""docforge: documents to clean, chunked, de-duplicated knowledge tables, as DataFrame transformations."""
