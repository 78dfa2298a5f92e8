"""lzseq: DataFrame-first engine for collections of highly similar sequences."""

__version__ = "0.1.0"
