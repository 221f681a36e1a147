"""Vector and loss expressions over arrays of double; NULL in gives NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def unit(a: Column) -> Column:
    """L2 norm 1, with a floor of 1e-9 on the norm."""
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))
    return F.transform(a, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """Exponentials over their sum, of the values over a temperature."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / F.lit(temperature)))
    return F.transform(e, lambda x: x / total(e))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    norm = F.ln(total(F.transform(a, lambda x: F.exp(x - top)))) + top
    return F.transform(a, lambda x: x - norm)


def kl(teacher: Column, student_logits: Column, temperature: float) -> Column:
    """Divergence of the student, not scaled, from the teacher, scaled by the temperature."""
    p, q = softmax(teacher, temperature), log_softmax(student_logits)
    return total(F.zip_with(p, q, lambda x, y: x * (F.ln(x) - y)))


def kl_binary(p: Column, q: Column, eps: float = 1e-8) -> Column:
    """The same for literal against the rest, from two probabilities of literal."""
    one = F.lit(1.0)
    return p * F.ln((p + eps) / (q + eps)) + (one - p) * F.ln((one - p + eps) / (one - q + eps))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hierarchy(binary: Column, kinds: Column) -> Column:
    """Joint log probabilities of literal and the figurative kinds from a two-headed model."""
    return F.concat(F.array(F.ln(sigmoid(-binary))), F.transform(log_softmax(kinds), lambda x: x + F.ln(sigmoid(binary))))


def masked_mean(tokens: Column, mask: Column, size: int) -> Column:
    """Mean of the token vectors whose mask is 1, with a floor of 1e-9 on their number; ``size`` is that of a vector."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x * m))
    sums = F.aggregate(kept, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(sums, lambda x: x / n)
