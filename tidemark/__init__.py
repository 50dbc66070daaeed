"""Daily and monthly normals, records and trends of station observations on Spark."""
