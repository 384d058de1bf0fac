"""Table-translation QA and clinical-rule coverage as Spark DataFrame operators."""
