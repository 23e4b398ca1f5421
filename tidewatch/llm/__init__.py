"""Training-data operators. Nothing outside this package imports it but the guarded entry module."""
