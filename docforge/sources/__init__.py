"""Where rows come from and go to: fetchers, tables, JDBC."""
