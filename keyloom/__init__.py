"""keyloom: table integration, quality checks and join-key discovery on PySpark."""
