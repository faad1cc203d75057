"""Operators for large text corpora: packing, mixing, archives, deduplication, scoring, rules, search and privacy.

Nothing outside this package imports it. Shared conventions: a null text is an empty text unless an operator
says otherwise; input columns that an operator does not name are never looked at or travel untouched inside one
struct, so no input column can clash with an operator's own names; an empty table gives an empty result.
"""
