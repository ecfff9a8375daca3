"""FHIR analytics on Spark: FHIRPath as Columns, references as joins, validation as a DataFrame."""
