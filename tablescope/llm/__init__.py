"""Training-data operators: packing, near-duplicates, sharding, archives, quality, decontamination.

Each module holds one operator with its own general interface; ``queries`` registers the thin
``opN_<name>`` queries of the driver contract on top of them. Nothing outside this subpackage
imports it.
"""
