"""ctxgraph: selecting and explaining context from large collections of files, as Spark DataFrame queries."""

from .pack import Pack, build_and_write_pack, build_pack  # noqa: E402

__all__ = ["Pack", "build_and_write_pack", "build_pack"]
