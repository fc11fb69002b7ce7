"""weftline: declarative PySpark operators for account-graph and corpus analytics."""
