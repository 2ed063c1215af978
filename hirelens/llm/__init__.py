"""Training-data operators (URL filters, quality rules, deduplication, packing, ...).

One module per operator; ``catalog`` registers one query per operator.
Nothing outside this subpackage imports it.
"""
