"""Market-data analytics on Spark: bronze, silver and gold tables, live state,
quality reports, document search and the streams behind them."""
