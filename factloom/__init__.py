"""factloom: document intelligence and entity resolution as Spark DataFrame operators."""
