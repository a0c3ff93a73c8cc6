"""Set-level anonymization of Portuguese legal text on Spark."""
