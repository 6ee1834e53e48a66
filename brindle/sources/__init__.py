"""Where rows come from and go to: the data store, documents, directories and synthetic data."""
