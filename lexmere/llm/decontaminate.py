"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds postings (document, position, term) of training tokens. A term
is a word with the word after it, so that lists of frequent words stay short; a
word alone is a term only where a test window is one word (or for proximity).
Terms that no test item uses are not stored; per document there is one end mark
that carries its number of words. Windows of test words are searched from their
rarest terms: the postings of each are shifted by the term's offset in the
window, so that lists of one window meet at the window's start, and are
intersected; what is left is intersected with the lists of the other terms.

A document row is known by its id and the hash of its text, so repeated ids
with different texts do not mix, and repeated rows get the same answer.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.session import small, stored

#: Code points below 0x80 that are no part of a word, after lower-casing A-Z.
BREAKS = "".join(chr(i) for i in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))

#: Rarest terms of a window whose lists are intersected first.
RAREST = 3

_KEY = ["doc", "h"]
#: The end mark: no word is empty.
_END = ""


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs of digits, letters and all that is not ASCII. Null: no words."""
    # NUL cannot be a translation target, so every break becomes a blank
    plain = F.translate(text, string.ascii_uppercase + BREAKS, string.ascii_lowercase + " " * len(BREAKS))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def windows(items: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(item, win) for every run of `length` words of an item; all of a shorter one; none without words."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).where("size(w) > 0")
    at = F.explode(F.expr(f"sequence(0, greatest(size(w) - {length}, 0))"))
    return w.select("item", "w", at.alias("at")).selectExpr("item", f"slice(w, at + 1, {length}) win").distinct()


def index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (doc, h, pos, term) of the terms in `vocabulary` (term), and an end mark (pos = number of words) per row of docs."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h"), words(text).alias("w"))
    alone = vocabulary.where("instr(term, ' ') = 0")
    pairs = vocabulary.where("instr(term, ' ') > 0").union(docs.sparkSession.range(1).selectExpr(f"'{_END}' term"))
    # the end mark is the one entry past the words; the last word has no next one and gives no term
    ends = F.arrays_zip(F.array_append("w", F.lit(_END)).alias("a"), F.array_append(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.lit(None)).alias("b"))
    tokens = rows.select(*_KEY, F.posexplode(ends).alias("pos", "t")).select(*_KEY, "pos", F.when(F.col("t.b").isNotNull(), F.concat("t.a", F.lit(" "), "t.b")).when(F.col("t.a") == _END, _END).alias("term"))
    found = tokens.join(small(pairs), "term", "left_semi")
    if not alone.isEmpty():
        found = found.union(rows.select(*_KEY, F.posexplode("w").alias("pos", "term")).join(small(alone), "term", "left_semi").select(found.columns))
    return stored(found)


def _meeting(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, h, wid, base): starts at which all the given terms (wid, off, term, need) of a window meet."""
    shifted = postings.join(small(terms), "term").selectExpr(*_KEY, "wid", "need", "pos - off base", "off").where("base >= 0")
    met = shifted.distinct().groupBy(*_KEY, "wid", "base", "need").count()
    return met.where("count = need").select(*_KEY, "wid", "base")


def _ranked(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored terms with their rank r in their window, the rarest first; windows with a term that no document has are left out, as they cannot occur."""
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")))
    of = W.partitionBy("wid")
    known = terms.join(small(counts), "term").withColumn("has", F.count("*").over(of)).where("has = lists")
    return stored(known.withColumn("r", F.row_number().over(of.orderBy("n", "off"))).drop("has", "n"))


def phrase_matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, h, wid, base, k): every place where all k words of a window stand in order, without gaps."""
    ranked = _ranked(postings, terms)
    first = ranked.where(F.col("r") <= RAREST).withColumn("need", F.least("lists", F.lit(RAREST)).cast("long")).select("wid", "off", "term", "need")
    found = stored(_meeting(postings, first))
    where = found.select(*_KEY).distinct()
    rest = ranked.where(F.col("r") > RAREST).select("wid", "k", "lists", "off", "term")
    held = postings.join(small(where), [postings.doc.eqNullSafe(where.doc), postings.h == where.h], "left_semi").selectExpr("doc _doc", "h _h", "pos _pos", "term _term")
    want = found.join(small(rest), "wid").selectExpr(*_KEY, "wid", "base", "k", "lists", "term", "cast(base + off as int) pos")
    hits = want.join(held, [want.doc.eqNullSafe(F.col("_doc")), want.h == F.col("_h"), want.pos == F.col("_pos"), want.term == F.col("_term")], "left_semi")
    full = hits.distinct().groupBy(*_KEY, "wid", "base", "k", "lists").count().where(f"count = lists - {RAREST}").select(*_KEY, "wid", "base", "k")
    short = small(ranked.where(f"r = 1 and lists <= {RAREST}").select("wid", "k"))
    return full.union(found.join(short, "wid").select(*_KEY, "wid", "base", "k"))


def proximity_matches(postings: DataFrame, terms: DataFrame, slack: int) -> DataFrame:
    """(doc, h, wid, base): places where every word of a window stands at most `slack` words from where the phrase would have it, base being the place of its rarest word less that word's offset. Postings and terms of single words."""
    ranked = _ranked(postings, terms)
    anchor = postings.join(small(ranked.where("r = 1")), "term").selectExpr(*_KEY, "wid", "lists", "pos - off base").distinct()
    near = anchor.join(small(ranked.where("r > 1").select("wid", "off", "term")), "wid").withColumn("pos", F.explode(F.expr(f"sequence(base + off - {slack}, base + off + {slack})")))
    p = postings.selectExpr("doc _doc", "h _h", "pos _pos", "term _term")
    met = near.join(p, [near.doc.eqNullSafe(p._doc), near.h == p._h, near.pos == p._pos, near.term == p._term], "left_semi")
    full = met.select(*_KEY, "wid", "base", "lists", "off").distinct().groupBy(*_KEY, "wid", "base", "lists").count().where("count = lists - 1")
    return full.select(*_KEY, "wid", "base").union(anchor.where("lists = 1").select(*_KEY, "wid", "base"))


def terms_of(wins: DataFrame, alone: bool = False) -> DataFrame:
    """(wid, k, lists, off, term) of distinct windows (wid, win): pairs of neighbours, or single words."""
    pairs = F.when((F.size("win") == 1) | F.lit(alone), F.col("win")).otherwise(F.zip_with(F.slice("win", 1, F.size("win") - 1), F.slice("win", 2, F.size("win")), lambda a, b: F.concat(a, F.lit(" "), b)))
    return wins.select("wid", F.size("win").alias("k"), pairs.alias("t")).select("wid", "k", F.size("t").alias("lists"), F.posexplode("t").alias("off", "term"))


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc, h, n_words, n_hit, n_items, items_sha256, contaminated).

    A window is `length` consecutive words of an item, or all words of a
    shorter one; a document word inside any occurrence of a window is hit.
    Null and wordless texts: no words, not contaminated; null and wordless
    items: no windows; null item ids count as no item but hit words. Repeated
    rows of docs or items, and texts of any length, change nothing; an empty
    items table leaves every document clean, empty docs give an empty result.
    Columns besides the id and the text are not read.
    """
    pairs = stored(windows(items, length, item_col, item_text_col))
    wins = stored(pairs.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win"))
    terms = stored(terms_of(wins))
    postings = index(docs, terms.select("term").distinct(), id_col, text_col)
    hits = stored(phrase_matches(postings, terms))

    spans = hits.select(*_KEY, "base", (F.col("base") + F.col("k")).alias("end")).groupBy(*_KEY, "base").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy(*_KEY).orderBy("base").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("base", F.coalesce(before, F.lit(0))))
    n_hit = spans.select(*_KEY, fresh.alias("fresh")).groupBy(*_KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))

    named = hits.select(*_KEY, "wid").distinct().join(small(pairs.where("item is not null").join(wins, "win").select("wid", "item")), "wid").select(*_KEY, "item").distinct()
    n_items = named.groupBy(*_KEY).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))

    own = postings.where(F.col("term") == _END).selectExpr(*_KEY, "cast(pos as long) n_words")
    same = lambda a, b: [a.doc.eqNullSafe(b.doc), a.h == b.h]
    out = own.join(n_hit, same(own, n_hit), "left").select(own.doc, own.h, "n_words", "n_hit")
    out = out.join(n_items, same(out, n_items), "left").select(out.doc, out.h, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an item contaminates; columns as given."""
    bad = contamination(docs, items, length, id_col, text_col).where("contaminated").select(F.col("doc").alias("_doc"), F.col("h").alias("_h")).distinct()
    return docs.join(bad, [docs[id_col].eqNullSafe(F.col("_doc")), F.xxhash64(docs[text_col].cast("string")) == F.col("_h")], "left_anti")
