"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Fixed patterns find the protected entities (e-mail, IP address, card, phone).
The corpus then tells which other terms give them away: over all lines, the
pointwise mutual information of a term t and a kind of entity e is
log2(P(t, e) / (P(t) P(e))), and the entity's own information is -log2 P(e).
A term discloses e when its mutual information reaches 1/alpha of that, that is
P(e | t) >= P(e) ** (1 - 1/alpha).  Entities are taken at two levels: the single
value (a name beside its owner's one address), with at least ``min_lines``
lines that hold both, and the kind, with at least ``min_values`` different
values beside the term.  Terms anywhere in a document that holds an entity they
disclose become spans of their own: those that all but name it (P(e | t) >=
``remove_from``) are removed, the others generalised to [TERM].

Terms are words of letters alone, lower-cased, outside entities.  Counts are grouped
with partial sums, so a frequent term costs one row per task; entity lines are
few and are the only ones whose words are placed.  Character positions come
from splitting a text at the very matches that are extracted: match i starts
after the first i+1 pieces and i matches.

The patterns are written so that Java's matcher neither recurses with the
length of a text nor scans a run twice; they match what the plain forms in the
comments match.

Defined results: null text counts as empty; a text without finds has no spans;
overlapping spans are all listed, and the sanitised text replaces their union
by the first one's mark; rows that share a doc_id and text give equal results;
an empty table gives an empty result; other columns pass through ``sanitise``
and are ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import collect_text, emitting, let, numbers
from .common import row_key, stored

#: Kinds in listed order.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : only tried where a run of name characters begins or a match has just ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 16 to 19 digits: whole runs of that many digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
#: A text without this character can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A term: letters with no digit or underscore beside them (pieces of keys and hashes are none).
LETTERS = r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])"

ALPHA = 1.5
MIN_VALUES = 5
MIN_LINES = 3
REMOVE_FROM = 0.9
BLOCK_CHARS = 512


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """Spans of one kind: kind, start, end (code points, end exclusive), value; null if there is none."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))
    # a fold copies arrays in its state at every step, so the starts are gathered as text and put beside the values again
    starts = numbers(collect_text(pairs, F.lit(0), lambda at, p: F.when(p["value"].isNull(), emitting(at)).otherwise(emitting(
        at + F.length(p["gap"]) + F.length(p["value"]), F.concat((at + F.length(p["gap"])).cast("string"), F.lit(";"))))), ("start",))
    placed = F.filter(F.zip_with(starts, values, lambda s, value: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"))),
                      lambda x: _valid(kind, x["value"]))
    held = text.rlike("[0-9]{4}") | text.rlike(r"[0-9][\x20-][0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
    return F.when(held & text.rlike(pattern), placed)


def base_spans(text: Column) -> Column:
    """All valid spans of the fixed patterns, by kind as listed, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.concat(*(F.coalesce(_matches(text, kind), none) for kind in KINDS))


def _words(line: Column) -> Column:
    """Distinct terms of a line, entities blanked first."""
    plain = line
    for kind in KINDS:
        needs = line.rlike("[0-9]{4}") | line.rlike(r"[0-9][\x20-][0-9]") if NEEDS[kind] is None else line.contains(NEEDS[kind])
        plain = F.when(needs, F.regexp_replace(plain, PATTERNS[kind], " ")).otherwise(plain)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(LETTERS), F.lit(0)))


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, min_values: int = MIN_VALUES, remove_from: float = REMOVE_FROM, min_lines: int = MIN_LINES) -> DataFrame:
    """term, kind, value (hash; null: the kind as a whole), share (P(entity | term)), pmi, information, removed."""
    lines = _lines(docs.select("text").where("text is not null")).where(F.col("line").rlike(LETTERS))
    # entities per line, for the few lines that hold any of the four characters' patterns
    marked = stored(lines.where(F.col("line").rlike("[@+0-9]")).select("line", base_spans(F.col("line")).alias("spans"))
                    .where(F.size("spans") > 0)
                    .select("line", F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.xxhash64(s["value"]).alias("value")))).alias("values")), "pii-lines")
    kinds = F.array_distinct(F.transform("values", lambda v: v["kind"]))
    whole = F.lit(None).cast("long").alias("value")
    beside = marked.select(F.explode(_words(F.col("line"))).alias("term"), "values")
    held = beside.select("term", F.explode(kinds).alias("kind")).groupBy("term", "kind").agg(F.count("*").alias("both"))
    pairs = stored(beside.select("term", F.explode("values").alias("v")).groupBy("term", F.col("v.kind").alias("kind"), F.col("v.value").alias("value")).agg(F.count("*").alias("both")), "pii-pairs")
    values = pairs.groupBy(F.col("term").alias("v_term"), F.col("kind").alias("v_kind")).agg(F.count("*").alias("n_values")).where(F.col("n_values") >= min_values)
    likely = held.join(values, (F.col("term") == F.col("v_term")) & (F.col("kind") == F.col("v_kind"))).select("term", "kind", whole, "both")
    likely = likely.unionAll(pairs.where(F.col("both") >= min_lines).select("term", "kind", "value", "both"))
    entity = (marked.select(F.explode(F.concat(F.transform(kinds, lambda k: F.struct(k.alias("kind"), whole)), F.col("values"))).alias("e"))
              .groupBy(F.col("e.kind").alias("e_kind"), F.col("e.value").alias("e_value")).agg(F.count("*").alias("n_entity")))
    # the empty term stands once on every line, so that one pass gives the number of lines too
    everywhere = stored(lines.select(F.explode(F.concat(_words(F.col("line")), F.array(F.lit("")))).alias("t_term")).groupBy("t_term").agg(F.count("*").alias("n_term")), "pii-words")
    total = (everywhere.where("t_term = ''").first() or (None, 0))[1]
    share = F.col("both") / F.col("n_term")
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.col("both") * float(total) / (F.col("n_term").cast("double") * F.col("n_entity")))
    return (likely.join(entity, (F.col("kind") == F.col("e_kind")) & F.col("value").eqNullSafe(F.col("e_value"))).join(everywhere, F.col("term") == F.col("t_term"))
            .select("term", "kind", "value", share.alias("share"), pmi.alias("pmi"), information.alias("information"), (share >= remove_from).alias("removed"))
            .where(F.col("pmi") * alpha >= F.col("information")))


def term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """row, doc_id, terms (kind term or removed, start, end): disclosing terms in the documents of the entities they disclose."""
    # equal rows would be numbered together, so each is placed once
    rows = found.where(F.size("spans") > 0).dropDuplicates(["row", "doc_id"]).select("row", "doc_id", "text", "spans")
    same = (F.col("row") == F.col("h_row")) & F.col("doc_id").eqNullSafe(F.col("h_id"))
    # a null value adds nothing to the hash, so a kind's key is that of the kind alone
    keys = F.array_distinct(F.concat(F.transform("spans", lambda s: F.xxhash64(s["kind"])), F.transform("spans", lambda s: F.xxhash64(s["kind"], F.xxhash64(s["value"])))))
    held = rows.select(F.col("row").alias("h_row"), F.col("doc_id").alias("h_id"), F.explode(keys).alias("h_key"))
    told = terms.select("term", F.xxhash64("kind", "value").alias("key"), "removed")
    hits = rows.select("row", "doc_id", F.explode(_words(F.col("text"))).alias("word")).join(told, F.col("word") == F.col("term")).join(held, same & (F.col("key") == F.col("h_key")))
    hits = hits.groupBy("row", "doc_id", "term").agg(F.max("removed").alias("removed"))
    wanted = hits.groupBy(F.col("row").alias("h_row"), F.col("doc_id").alias("h_id")).agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("wanted"))
    order = Window.partitionBy("row", "doc_id")
    before = Window.unboundedPreceding, -1
    lines = _lines(rows.join(wanted, same), "row", "doc_id", "wanted")
    lines = lines.withColumn("begin", F.coalesce(F.sum(F.length("line") + 1).over(order.orderBy("line_no").rowsBetween(*before)), F.lit(0)))
    lines = lines.where(F.arrays_overlap(F.transform(F.regexp_extract_all("line", F.lit(LETTERS), F.lit(0)), F.lower), F.map_keys("wanted")))
    # no pattern matches across lines, so a line's spans are those of the line alone
    words = lines.withColumn("own", base_spans(F.col("line"))).select("row", "doc_id", "line_no", "begin", "own", "wanted", F.posexplode(
        F.arrays_zip(F.split("line", LETTERS, -1).alias("gap"), F.regexp_extract_all("line", F.lit(LETTERS), F.lit(0)).alias("word"))).alias("k", "w"))
    in_line = Window.partitionBy("row", "doc_id", "line_no").orderBy("k").rowsBetween(*before)
    size = F.length("w.gap") + F.coalesce(F.length("w.word"), F.lit(0))
    words = words.withColumn("start", (F.col("begin") + F.coalesce(F.sum(size).over(in_line), F.lit(0)) + F.length("w.gap")).cast("int"))
    words = words.where(F.col("w.word").isNotNull()).withColumn("end", F.col("start") + F.length("w.word"))
    words = words.where(~F.exists("own", lambda s: (s["start"] + F.col("begin") < F.col("end")) & (s["end"] + F.col("begin") > F.col("start"))))
    words = words.withColumn("removed", F.try_element_at("wanted", F.lower("w.word"))).where(F.col("removed").isNotNull())
    span = F.struct("start", "end", F.when(F.col("removed"), "removed").otherwise("term").alias("kind"))
    return words.groupBy(F.col("row").alias("t_row"), F.col("doc_id").alias("t_id")).agg(F.array_sort(F.collect_list(span)).alias("terms"))


def find(docs: DataFrame, alpha: float = ALPHA, min_values: int = MIN_VALUES, remove_from: float = REMOVE_FROM, keep_text: bool = False) -> DataFrame:
    """doc_id, spans (kind, start, end, value: fixed patterns), terms (kind, start, end), and the text where asked for."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    # written once, with the text only where there are spans to look around (or where the caller asks for it)
    found = rows.select("row", "doc_id", "text", base_spans(F.col("text")).alias("spans"))
    found = stored(found if keep_text else found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii-documents")
    terms = stored(disclosing_terms(docs, alpha, min_values, remove_from), "pii-terms")
    extra = term_spans(found, terms)
    columns = ["row", "doc_id", "spans"] + ["text"] * keep_text
    out = found.select(*columns).join(extra.hint("shuffle_hash"), (F.col("row") == F.col("t_row")) & F.col("doc_id").eqNullSafe(F.col("t_id")), "left")
    return out.select(*columns[1:], F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("terms"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, hash of the base spans, all spans (terms last, as kind term)."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat(base, terms)).alias("spans"))


def masked(text: Column, spans: Column, terms: Column) -> Column:
    """The text with every span replaced by its kind's mark; of overlapping spans the first one's."""
    slim = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    marks = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    every = F.array_sort(F.concat(F.transform(spans, slim), F.transform(terms, slim)))

    def replaced(blocks: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            """A stretch of the text, read from the blocks that hold it: reading it from the text would count from its start each time."""
            first = F.floor(start / BLOCK_CHARS).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK_CHARS).cast("int") - first + 1), "")
            return F.substring(held, start - first * BLOCK_CHARS + 1, end - start)

        rest = lambda at: F.concat(part(at, (F.floor(at / BLOCK_CHARS).cast("int") + 1) * BLOCK_CHARS), F.array_join(
            F.slice(blocks, F.floor(at / BLOCK_CHARS).cast("int") + 2, F.size(blocks) + 1), ""))
        return collect_text(every, F.lit(0), lambda at, x: F.when(x["start"] < at, emitting(F.greatest(at, x["end"]))).otherwise(
            emitting(x["end"], F.concat(part(at, x["start"]), marks[x["kind"]]))), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    return F.when((F.size(spans) > 0) | (F.size(terms) > 0), let(blocks, replaced)).otherwise(text)


def sanitise(docs: DataFrame, alpha: float = ALPHA, min_values: int = MIN_VALUES, remove_from: float = REMOVE_FROM) -> DataFrame:
    """All columns of ``docs`` with personal data and disclosing terms replaced in the text (null stays null)."""
    rows = docs.withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    source = docs.where("text is not null").select("doc_id", "text")
    found = source.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).select("row", "doc_id", "text", base_spans(F.col("text")).alias("spans"))
    few = stored(found.where(F.size("spans") > 0).dropDuplicates(["row", "doc_id"]), "pii-documents")
    terms = stored(disclosing_terms(docs, alpha, min_values, remove_from), "pii-terms")
    extra = term_spans(few, terms)
    changed = few.join(extra, (F.col("row") == F.col("t_row")) & F.col("doc_id").eqNullSafe(F.col("t_id")), "left")
    changed = changed.select(F.col("row").alias("_c_row"), F.col("doc_id").alias("_c_id"), "spans", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("terms"), "text")
    changed = changed.select("_c_row", "_c_id", masked(F.col("text"), F.col("spans"), F.col("terms")).alias("_c_text"))
    out = rows.join(changed.hint("shuffle_hash"), (F.col("_row") == F.col("_c_row")) & F.col("doc_id").eqNullSafe(F.col("_c_id")), "left")
    return out.select(*(F.coalesce("_c_text", "text").alias(c) if c == "text" else F.col(c) for c in docs.columns))
