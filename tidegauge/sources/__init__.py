"""Where rows come from: tables, records, documents, and the catalogue relations over them."""
