"""Market analytics on Spark: bars, cleaning, features, star schema, SQL models, risk and regimes."""
