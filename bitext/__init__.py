"""bitext: DataFrame operators for corpora of parallel (two-language) documents."""

__version__ = "0.1.0"
