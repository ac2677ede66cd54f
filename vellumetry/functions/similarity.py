"""Similarity of labels and of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def label_similarity(a_tokens: Column, a_chars: Column, b_tokens: Column, b_chars: Column) -> Column:
    """Half the Jaccard similarity of words, half that of characters; 1 if both are empty, 0 if one is."""
    return shares_similarity(share(a_tokens, b_tokens), a_chars, b_chars)


def shares_similarity(words: Column, a_chars: Column, b_chars: Column) -> Column:
    """As label_similarity, where the words' similarity is known."""
    no_a, no_b = F.size(a_chars) == 0, F.size(b_chars) == 0
    return F.when(no_a & no_b, 1.0).when(no_a | no_b, 0.0).otherwise(F.round(0.5 * words + 0.5 * share(a_chars, b_chars), 4))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of meaningful words; 1 if neither side has any."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
