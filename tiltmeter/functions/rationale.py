"""Comparison of rationales, and word attributions from subword scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import let, lit_array

# Stop words, the similarity below which a rationale counts as
# changed, special tokens of the tokenizers, and the number of tokens kept.
STOP_WORDS = [
    "a", "an", "the", "is", "was", "are", "were", "in", "on", "at",
    "of", "to", "and", "or", "for", "with", "by", "from", "that",
    "this", "it", "its", "as", "be", "been", "being", "has", "have",
    "had", "do", "does", "did", "not", "no", "but", "if", "so",
]
CHANGE_BELOW = 0.85
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>"]
TOP_TOKENS = 10


def content_words(text: Column) -> Column:
    """Distinct lower-case a–z words that stand alone, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), lit_array(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    def share(p):
        union = F.size(F.array_union(p["a"], p["b"]))
        return F.when(union > 0, F.size(F.array_intersect(p["a"], p["b"])).cast("double") / F.greatest(union, F.lit(1))).otherwise(1.0)

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def rationale_changed(before: Column, after: Column) -> Column:
    """Any paired item diverged; items without a partner do not count, an empty side means no."""
    n = F.least(F.size(before), F.size(after))
    m = F.greatest(n, F.lit(0))
    diverged = F.zip_with(F.slice(before, 1, m), F.slice(after, 1, m),
                          lambda b, a: jaccard(content_words(b), content_words(a)) < CHANGE_BELOW)
    return F.when(n > 0, F.array_contains(diverged, True)).otherwise(F.lit(False))


def mentions(items: Column, token: Column) -> Column:
    needle = F.lower(F.coalesce(token, F.lit("")))
    return (needle != "") & F.exists(items, lambda x: F.contains(F.lower(x), F.btrim(needle)))


def word_attributions(tokens: Column, scores: Column) -> Column:
    """array<struct<word, score>> by falling |score|, six decimals.

    Continuation pieces (##) join the word before them; word-start marks are
    dropped; special tokens and empty words are left out. One row in, one array
    out: a text's tokens never leave their row.
    """
    both = F.zip_with(tokens, scores, lambda t, x: F.struct(t.alias("t"), x.alias("s")))
    kept = F.filter(both, lambda z: ~z["t"].isin(SPECIAL_TOKENS))

    def clean(t):
        return F.when(t.startswith("##"), F.substring(t, 3, 2147483647)).otherwise(F.regexp_replace(t, "^[Ġ▁]+", ""))

    def words(tok):
        starts = F.filter(F.transform(tok, lambda z, i: F.when((i == 0) | ~z["t"].startswith("##"), i)), lambda i: i.isNotNull())

        def pieces(st):
            def word(i, k):
                part = F.slice(tok, i + 1, F.coalesce(F.get(st, k + 1), F.size(tok)) - i)
                return F.struct(F.array_join(F.transform(part, lambda z: clean(z["t"])), "").alias("word"),
                                F.aggregate(part, F.lit(0.0), lambda a, z: a + z["s"]).alias("score"), k.alias("k"))

            return F.transform(st, word)

        return let(starts, pieces)

    found = F.filter(let(kept, words), lambda w: w["word"] != "")
    ordered = F.array_sort(F.transform(found, lambda w: F.struct((-F.abs(w["score"])).alias("o"), w["k"].alias("k"), w["word"].alias("word"),
                                                                 w["score"].alias("score"))))
    return F.transform(ordered, lambda w: F.struct(w["word"].alias("word"), F.round(w["score"], 6).alias("score")))
