"""DataFrame -> DataFrame operators, chained with ``df.transform``."""
