"""arbora: bagged decision forests as ordinary Spark SQL / DataFrame plans."""

__version__ = "0.1.0"
