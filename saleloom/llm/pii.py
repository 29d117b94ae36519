"""Personal data: patterns, and terms that reveal what the patterns protect.

Every value that a pattern finds is a protected entity, and so is the group it belongs to: an address's
domain, the net of an ip, a card's issuer, a number's prefix. Groups stand in many texts where the values
themselves stand in one, and a term that gives away the domain narrows down the address. A term is
disclosive of an entity if their pointwise mutual information over the whole corpus comes near the entity's
information content: PMI(c; t) = log2(n(c,t) N / (n(c) n(t))) against IC(c) = log2(N / n(c)). All four count
documents, and entity and term meet wherever one document holds both. Copies of one text are one witness: a
pair needs MIN_TEXTS different texts, since in a single text every rare word would be exclusive. From
GENERALISE on the share PMI / IC makes a term a word without name, from REMOVE on it goes. Terms are touched
wherever a document holds their entity.

A term in n(t) documents shares at most all of them with an entity, so only terms of up to N^(1-g) n(c)^g
documents, g = GENERALISE, can reach the threshold. Words are held against that before they are paired, which
leaves out the frequent ones, nearly all of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleloom.llm.common import row_key, ship
from saleloom.session import stored

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalise", "remove")
MIN_TEXTS = 2
GENERALISE, REMOVE = 0.80, 0.95
COUNTED_TERMS = 500_000  # distinct terms that a task holds before it hands on its counts
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[WORD]", "remove": ""}

# ---- fixed values: the patterns -----------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of this kind ends with a run of digits and one that fails inside a run fails all along it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# every text with a span matches this one; Spark's own regular expressions read it
MAY_HOLD = (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
            r"|[0-9](?:[ -]?[0-9]){12}|\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one walk: the run of local characters before an @ that a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _value(kind: str, found: str) -> str:
    return found.lower() if kind in ("email", "ip") else "".join(c for c in found if "0" <= c <= "9")


def group_of(kind: str, value: str) -> str:
    """The coarser entity that a value belongs to."""
    if kind == "email":
        return f"domain:{value.rpartition('@')[2]}"
    if kind == "ip":
        return f"net:{value.rpartition('.')[0]}"
    return f"issuer:{value[:6]}" if kind == "card" else f"prefix:{value[:-4]}"


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def entities_and_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[dict]]:
    """Distinct entities of a text, their groups among them, and the term and place of every word outside the spans."""
    taken = sorted((a, b) for _, a, b in spans)
    words, at, reach = [], 0, -1
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            words.append({"term": _hash(m[0].lower()), "start": m.start(), "end": m.end()})
    values = {(kind, _value(kind, text[a:b])) for kind, a, b in spans}
    return sorted({_hash(name) for kind, v in values for name in (f"{kind}:{v}", group_of(kind, v))}), words


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
_NEAR = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("term", "start", "end")]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW_NEAR = pa.list_(pa.struct([(n, pa.int64()) for n in ("term", "start", "end")]))


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, spans of the patterns, and where there are any their entities and the words beside them, for every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{text}`")).alias("key"),
                       F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("spans", _SPAN),
                           T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("near", _NEAR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                spans, entities, near = [], [], []
                for value in part.column("text"):
                    found = base_spans(t := value.as_py())
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                    held, words = entities_and_words(t, found) if found else ([], [])
                    entities.append(held)
                    near.append(words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(spans, _ARROW_SPAN),
                     pa.array(entities, pa.list_(pa.int64())), pa.array(near, _ARROW_NEAR)],
                    names=["doc_id", "key", "spans", "entities", "near"])

    return rows.mapInArrow(run, schema)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (hash) and the number of documents that hold it; tasks hand on sums."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def summed() -> Iterator[pa.RecordBatch]:
            names = list(counts)
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(map(_hash, part), pa.int64()),
                                                  pa.array(map(counts.__getitem__, part), pa.int64())], names=["term", "n"])

        for batch in batches:
            for value in batch.column(0):
                if t := value.as_py():
                    counts.update({w.lower() for w in set(_TERM.findall(t))})
                    if len(counts) >= COUNTED_TERMS:
                        yield from summed()
                        counts.clear()
        yield from summed()

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n_term"))


def disclosive(found: DataFrame, terms: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE,
               least: int = MIN_TEXTS) -> DataFrame:
    """entity, term and kind of every pair at or over the threshold, from the stored rows of ``detect``."""
    held = found.filter("size(entities) > 0")
    by_text = held.select("key", F.explode("entities").alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"))
    n_entity = by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    n_entity = stored(n_entity.filter(F.col("texts") >= least).select("entity", "n_entity"), "entities")
    total = F.lit(found.count()).cast("double")
    most = n_entity.agg(F.coalesce(F.max("n_entity"), F.lit(0).cast("long"))).first()[0]

    def within_reach(n_entity: Column) -> Column:
        # n_both <= n_term, so PMI <= log2(N / n_term) where the term is the more frequent one; a little room for rounding
        return F.col("n_term") <= F.pow(total, F.lit(1 - generalise)) * F.pow(n_entity, F.lit(generalise)) * (1 + 1e-9)

    # an entity of every document tells nothing, and a term needs as many documents as a pair needs texts
    rare = terms.filter((F.col("n_term") >= least) & (within_reach(F.lit(float(most))) | (F.col("n_term") <= most)))
    known = stored(by_text.join(n_entity, "entity"), "known")
    # only texts with an entity that can have a pair; their copies go once words lie by term, which needs no shuffle of its own
    texts = held.select("key", F.array_distinct(F.col("near.term")).alias("terms")).join(known.select("key").distinct(), "key", "left_semi")
    words = texts.select("key", F.explode("terms").alias("term")).join(rare, "term").distinct()
    near = (known.join(words, "key")
            .filter(within_reach(F.col("n_entity")) | (F.col("n_term") <= F.col("n_entity"))))
    pairs = (near.groupBy("entity", "term").agg(F.max("n_term").alias("n_term"), F.sum("n").alias("n_both"), F.count("*").alias("texts"))
             .filter(F.col("texts") >= least).join(n_entity, "entity"))
    share = (F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
             / F.log2(total / F.col("n_entity")))
    share = F.when(F.col("n_entity") < total, share)
    rated = pairs.withColumn("share", share).filter(F.col("share") >= generalise)
    return rated.select("entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind"))


def term_spans(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, key and the added spans of the rows that have any; the stronger measure wins a place.

    An entity's terms are as many as its texts make them, so the two never meet by entity alone: a text's
    words come first, those of them that are terms at all, and each with an entity of its text is looked up.
    """
    pairs = stored(pairs, "pairs")
    held = found.filter("size(entities) > 0")
    places = held.select("doc_id", "key", F.explode("near").alias("x")).select("doc_id", "key", "x.term", "x.start", "x.end")
    places = stored(places.join(pairs.select("term").distinct(), "term"), "places")
    entities = (held.select("key", F.explode("entities").alias("entity"))
                .join(pairs.select("entity").distinct(), "entity", "left_semi").distinct())
    met = places.select("key", "term").distinct().join(entities, "key").join(pairs, ["entity", "term"])
    terms = stored(met.groupBy("key", "term").agg(F.max("kind").alias("kind")), "touched")
    return (places.join(terms, ["key", "term"]).distinct()
            .groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", generalise: float = GENERALISE,
         remove: float = REMOVE) -> DataFrame:
    """doc_id, key, spans (patterns) and added (terms) of every row.

    Null and empty texts have no spans. Equal rows get equal results; a null doc_id is one more value.
    An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    found = stored(detect(docs, text, doc_id), "pii")
    pairs = disclosive(found, term_counts(docs, text), generalise, remove)
    added = stored(term_spans(found, pairs), "terms").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    same = found["doc_id"].eqNullSafe(added["_doc"]) & (found["key"] == added["_key"])
    none = F.array().cast(_SPAN)
    return found.join(added, same, "left").select("doc_id", "key", "spans", F.coalesce("added", none).alias("added"))


def span_digests(docs: DataFrame) -> DataFrame:
    found = find(docs)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def shown(spans: str):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    base = F.array_join(shown("spans"), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"),
                        F.array_join(F.concat(shown("spans"), shown("added")), ",").alias("spans"))


def replace_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans give way to their label; of overlapping ones the first, and of those the longest, counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], LABELS[kind]]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of every text replaced; n_chars, where there is one, follows the text.

    Only texts that may hold a pattern meet the added spans; the others stay where they lie.
    """
    added = stored(find(docs).filter("size(added) > 0").select(
        F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("added").alias("_added")).dropDuplicates(["_doc", "_key"]),
        "added")
    names = docs.columns
    may_hold = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    rows = docs.filter(may_hold).select(F.struct("*").alias("row"), row_key(F.col("text")).alias("_row_key"))
    same = F.col("row.doc_id").eqNullSafe(added["_doc"]) & (F.col("_row_key") == added["_key"])
    met = rows.join(added, same, "left").select("row.*", "_added")
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                texts = []
                for value, more in zip(part.column(place), part.column(len(names)), strict=True):
                    text = value.as_py()
                    spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in more.as_py() or ()]
                    texts.append(replace_spans(text, spans) if spans else text)
                columns = list(part.columns[:-1])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.filter(~may_hold).union(met.mapInArrow(run, docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


