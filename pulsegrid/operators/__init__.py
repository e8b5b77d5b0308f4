"""DataFrame -> DataFrame operators over many recordings at once."""
