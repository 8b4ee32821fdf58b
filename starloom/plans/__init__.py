"""Plan assembly: the warehouse, registered views, ad-hoc SQL, query catalogue."""
