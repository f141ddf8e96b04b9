"""Personal data: patterns find it, and corpus co-occurrence finds the words that give it away.

Protected entities are the values the patterns find, and secrets (keys, tokens, passwords in a setting). Any word
of a document that mentions an entity reveals it as far as the corpus ties the two together: disclosure =
log(P(entity | word) / P(entity)) / IC(entity), with P(entity | word) = documents with both / (documents with the
word + 2), so about 1 for a word that many documents hold and each beside the entity, less the fewer sightings there
are, and about 0 for a word that occurs everywhere. Words over the threshold are replaced wherever they occur in the
documents that mention any entity: by their beginning, if that reveals less than the threshold, and removed if not.
Documents without personal data stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import materialized
from .tables import whole_text

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: The first so many kinds are the base.
BASE = 4
#: Same matches as the plain patterns, leftmost and without overlap, but linear: a run is entered at its
#: first character or where the last match ended, and is never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
              r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++|(?i:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s,;]{6,}+)",
}
#: A document without it has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PREFIX_LETTERS, THRESHOLD = 4, 0.8
#: A word: letters and digits, also with apostrophes and hyphens inside; one letter at least, two characters at least.
WORD = r"[A-Za-z0-9\p{L}\p{M}\p{N}]++(?:['’-][A-Za-z0-9\p{L}\p{M}\p{N}]++)*+"
#: Words outside addresses and secrets (group 1).
_TOKEN = r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|" + PATTERNS["secret"] + ")|(" + WORD + ")"
#: Keys in more than this share of the documents are looked up by broadcast: there are at most 1 / share times a document's mean number of keys.
COMMON = 0.01
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals, the element itself included, in two levels so that long arrays stay cheap."""
    fold = lambda part: F.aggregate(part, zero, merge)
    heads = lambda v: F.filter(v, lambda x, i: i % _BLOCK == 0)
    return _let(values, lambda v: _let(
        F.transform(heads(v), lambda x, b: fold(F.slice(v, b * _BLOCK + 1, _BLOCK))), lambda sums: _let(
            F.transform(sums, lambda x, b: fold(F.slice(sums, 1, b))), lambda before: F.transform(v, lambda x, i: merge(
                F.get(before, F.floor(i / _BLOCK).cast("int")), fold(F.slice(v, i - i % _BLOCK + 1, i % _BLOCK + 1)))))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    """Whether a match is one: parts of an address, check digit, number of digits."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        def luhn(digits: Column) -> Column:
            places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: digits.substr(F.length(digits) - i + 1, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
            return F.aggregate(places, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
        return _let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _is_word(token: Column) -> Column:
    return (F.length(token) > 1) & token.rlike(r"\p{L}")


def _may_hold(text: Column, kind: str) -> Column:
    """False only if a text has no match: a plain search is much cheaper than the pattern."""
    if kind == "secret":
        starts = ("AKIA", "eyJ", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
        named = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
        any_of = lambda t, parts: reduce(or_, [F.contains(t, F.lit(p)) for p in parts])
        return any_of(text, starts) | (named & _let(F.lower(text), lambda t: any_of(t, ("passw", "secret", "token", "api"))))
    return F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    mixed = _may_hold(text, "email") | _may_hold(text, "secret")
    tokens = F.when(mixed, F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(F.array_distinct(tokens), _is_word), lambda w: F.lower(w)))


def _ends(pieces: Column, found: Column) -> Column:
    """Where each match ends, in characters, from the matches and the pieces between them."""
    return _running(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)), F.lit(0), lambda a, b: a + b)


def _places(text: Column) -> Column:
    """Array of (term, start, end): every word of a text as ``_words`` counts it."""
    both = F.struct(F.split(text, _TOKEN, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("found"),
                    F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)).alias("words"))
    def of(both: Column) -> Column:
        return _let(_ends(both["pieces"], both["found"]), lambda ends: F.transform(both["words"], lambda w, i: F.struct(
            w.alias("term"), (F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"))))
    places = F.filter(_let(both, of), lambda p: _is_word(p["term"]))
    return F.transform(places, lambda p: F.struct(F.lower(p["term"]).alias("term"), p["start"].alias("start"), p["end"].alias("end")))


def _mentions(text: Column, kind: str) -> Column:
    """Array of (start, end, kind, entity) of one kind; positions in code points, end exclusive."""
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    key = lambda m: F.concat(F.lit(f"{kind}:"), F.lower(m) if kind == "email" else m if kind in ("ip", "secret") else _digits(m))

    def spans(both: Column) -> Column:
        def one(m: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i)
            return F.when(_passes(kind, m), F.struct((end - F.length(m)).alias("start"), end.alias("end"), F.lit(number).alias("kind"), key(m).alias("entity")))
        return _let(_ends(both["pieces"], both["found"]), lambda ends: F.filter(F.transform(both["found"], lambda m, i: one(m, i, ends)), lambda x: x.isNotNull()))

    none = F.array().cast("array<struct<start:int,end:int,kind:int,entity:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(_may_hold(text, kind), _let(both, spans)).otherwise(none)


def _found(docs: DataFrame, id: str, text: str, carry: list[Column]) -> DataFrame:
    """One written row per document: ``__at``, ``id``, ``base`` and ``secrets`` (spans), ``entities`` (distinct), and ``carry``;
    ``__text`` and ``words`` (distinct) of documents with entities."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), whole_text(f"`{text}`").alias("__t"), F.monotonically_increasing_id().alias("__at"), *carry)
    rows = rows.withColumn("m", F.concat(*[_mentions(F.col("__t"), k) for k in KINDS[:-1]]))
    spans = lambda wanted: F.array_sort(F.transform(F.filter("m", wanted), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = [c for c in rows.columns if c not in ("__t", "m")]
    return materialized(rows.select(*names, spans(lambda x: x["kind"] < BASE).alias("base"), spans(lambda x: x["kind"] >= BASE).alias("secrets"),
                                    F.array_distinct(F.transform("m", lambda x: x["entity"])).alias("entities"),
                                    F.when(F.size("m") > 0, F.col("__t")).alias("__text"), F.when(F.size("m") > 0, _words(F.col("__t"))).alias("words")))


def _stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, PREFIX_LETTERS), F.lit("*"))


def _looked_up(rows: DataFrame, counted: DataFrame, key: str, common: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``counted`` for their key. Keys of ``common`` come by broadcast, so no key that many rows share is shuffled."""
    often = rows.join(F.broadcast(counted.join(F.broadcast(common), key, "left_semi")), key)
    seldom = rows.join(F.broadcast(common), key, "left_anti").join(counted.join(F.broadcast(common), key, "left_anti"), key)
    return often.unionByName(seldom)


def _disclosing(found: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``term``, ``removed``: words that say too much of an entity, from counts of all documents; and the common words.

    Entities of the very same documents are told apart by no word, so they are one class. A word can only be over the
    threshold if few enough documents hold it; the others of a document never meet its entities.
    """
    n = found.count()
    common = lambda counted, key, count: materialized(counted.where(F.col(count) > COMMON * n).select(key))
    terms = lambda: F.explode(F.concat("words", F.array_distinct(F.transform("words", _stem)))).alias("term")
    words = docs.select(_words(whole_text(f"`{text}`")).alias("words"))
    words = materialized(words.select(terms()).groupBy("term").agg(F.count("*").alias("with_term")))
    often = common(words, "term", "with_term")

    having = found.where(F.size("entities") > 0)
    entities = having.select("__at", F.explode("entities").alias("entity"))
    same = [F.bit_xor(F.xxhash64("__at", F.lit(k))).alias(f"same{k}") for k in range(2)]
    classes = materialized(entities.groupBy("entity").agg(F.count("*").alias("with_entity"), *same))
    name = ["with_entity", "same0", "same1"]
    classes = materialized(_looked_up(entities, classes, "entity", common(classes, "entity", "with_entity")).select("__at", *name).distinct())

    held = _looked_up(having.select("__at", terms()), words, "term", often)
    may = F.col("with_term") + 2 <= F.least("with_entity", "with_term") * F.pow(F.lit(n) / F.col("with_entity"), F.lit(1 - THRESHOLD))
    pairs = held.join(classes, "__at").where(may).groupBy(*name, "term", "with_term").agg(F.count("*").alias("both"))
    ic = F.log(F.lit(n) / F.col("with_entity"))
    gain = F.log(F.col("both") * F.lit(n) / (F.col("with_entity") * (F.col("with_term") + 2)))
    over = materialized(pairs.where((ic > 0) & (gain >= THRESHOLD * ic)).select(*name, "term"))
    stems = over.where(F.col("term").endswith("*")).select(*name, F.col("term").alias("stem"), F.lit(True).alias("tells"))
    over = over.where(~F.col("term").endswith("*")).withColumn("stem", _stem(F.col("term"))).join(stems, [*name, "stem"], "left")
    # a word no longer than the stem has nothing to hide behind
    removed = F.coalesce("tells", F.lit(False)) | (F.length("term") <= PREFIX_LETTERS)
    return materialized(over.groupBy("term").agg(F.max(removed).alias("removed"))), often


def _spans(docs: DataFrame, id: str, text: str, carry: list[Column]) -> DataFrame:
    """``_found`` with ``terms``: places of disclosing words (start, end, removed), or null. Only rows with mentions are shuffled."""
    found = _found(docs, id, text, carry)
    some = F.size("entities") > 0
    having = found.where(some)
    disclosing, often = _disclosing(found, docs, text)
    hits = materialized(_looked_up(having.select("__at", F.explode("words").alias("term")), disclosing, "term", often))
    places = having.select("__at", F.explode(_places(F.col("__text"))).alias("p")).select("__at", "p.term", "p.start", "p.end")
    terms = places.join(hits, ["__at", "term"]).groupBy("__at").agg(F.collect_list(F.struct("start", "end", "removed")).alias("terms"))
    # a word glued to a mention goes, or stays, with it
    apart = lambda t: ~F.exists(F.concat("base", "secrets"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    own = F.filter("terms", apart)
    marked = having.join(materialized(terms), "__at", "left").withColumn("terms", F.when(F.size(own) > 0, own))
    return marked.unionByName(found.where(~some), allowMissingColumns=True)


def _all_spans() -> Column:
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")),
                        lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat("base", "secrets", terms))


def _said(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``base`` and ``spans`` (arrays of start, kind, end; kinds as in KINDS), ``n_removed``, ``n_generalised``.

    Null counts as empty, an empty text has no spans, repeated rows are documents of their own. A document
    is one row throughout, so its own spans are the only group that is gathered.
    """
    rows = _spans(docs, id, text, [])
    count = lambda removed: F.coalesce(F.size(F.filter("terms", lambda t: t["removed"] == removed)), F.lit(0)).cast("long")
    return rows.select(F.col("id").alias(id), "base", _all_spans().alias("spans"), F.when(F.col("terms").isNull(), 0).otherwise(count(True)).cast("long").alias("n_removed"),
                       F.when(F.col("terms").isNull(), 0).otherwise(count(False)).cast("long").alias("n_generalised"))


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text, from what ``find`` returns."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(BASE)]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("secret"))).cast("long").alias("n_secret")
    return found.select(id, *counts, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), secrets, "n_removed", "n_generalised")


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they came but for the text: personal data is replaced by its kind in
    brackets, a generalised word by its beginning and ``*``, a removed word by ``[term]``.

    Spans that overlap are replaced once, under the first one's name. Null texts stay null.
    """
    names = docs.columns
    rows = _spans(docs, id, text, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")])
    old = F.col(f"__row.`{text}`")
    label = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base = F.transform(F.concat("base", "secrets"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(label, s["kind"]).alias("put")))
    def word(t: Column) -> Column:
        put = F.when(t["removed"], F.lit("[term]")).otherwise(F.concat(old.substr(t["start"] + 1, F.lit(PREFIX_LETTERS)), F.lit("*")))
        return F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), t["end"].alias("end"), put.alias("put"))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")), word)

    def rebuilt(spans: Column) -> Column:
        def put_in(covered: Column) -> Column:
            def part(s: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(covered, i - 1)).otherwise(0)
                return F.when(s["start"] >= before, F.concat(old.substr(before + 1, s["start"] - before), s["put"])).otherwise("")
            last = F.element_at(covered, -1)
            return F.concat(F.array_join(F.transform(spans, part), ""), old.substr(last + 1, F.length(old)))
        return _let(_running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), put_in)
    has = (F.size("base") > 0) | (F.size("secrets") > 0) | F.col("terms").isNotNull()
    new = F.when(has, _let(F.array_sort(F.concat(base, terms)), rebuilt)).otherwise(old)
    return rows.select(*[(new if c == text else F.col(f"__row.`{c}`")).alias(c) for c in names])
