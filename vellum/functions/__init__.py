"""Column expressions. Every function here returns a ``pyspark.sql.Column`` evaluated in the JVM."""
