"""Imports every operator module, which registers its query."""

from weekwatch.llm import alignment, chat, fptree, linededup, mixing, packing, ppm, quality, reputation, simhash, topk, warc, wrapper  # noqa: F401
