"""Resolution of variables and construction of output documents as Spark columns."""
