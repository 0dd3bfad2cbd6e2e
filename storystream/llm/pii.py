"""Personal data, and the terms around it that give it away.

Four plain kinds (e-mail addresses, IP addresses, payment cards, phone numbers)
are found by patterns. They are the protected entities of an information-theoretic
sanitisation (after Sanchez and Batet's C-sanitisation): from the whole corpus it is
counted how often a term stands near an entity and how often it stands anywhere.
The pointwise mutual information of term and entity, as a part of the entity's own
information, says how much of the entity the term discloses. Terms beyond a first
threshold are generalised where they stand near the entity, beyond a second removed.

Everything is column expressions. Built-in functions give matches but not their
places, so a text is also split at the same pattern: lengths of the pieces and
matches, summed up, are the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storystream.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")

# Fixed patterns, written without backtracking: a run of characters is tried from its start only
# (or from the end of the last match), and repetitions give nothing back, which no match needs
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)

#: Characters on each side of an entity in which terms are looked for
CONTEXT = 120
#: Part of an entity's information that a term may disclose
GENERALISE, REMOVE = 0.8, 0.95
_TERM = r"[\p{L}\p{N}]+"
_CHUNK = 256


def _running(lengths: str) -> str:
    """SQL for running sums of an array, in chunks, so that long arrays are not copied at each step."""
    inner = (
        "aggregate({0}, array({1}), (sums, x) -> concat(sums, array(element_at(sums, -1) + x)),"
        " sums -> slice(sums, 2, size(sums)))"
    )
    chunks = f"transform(sequence(0, size({lengths}) div {_CHUNK}), c -> slice({lengths}, c * {_CHUNK} + 1, {_CHUNK}))"
    total = "aggregate(chunk, 0L, (sum, x) -> sum + x)"
    offsets = (
        f"aggregate({chunks}, array(0L), (sums, chunk) -> concat(sums, array(element_at(sums, -1) + {total})))"
    )
    sums = inner.format("part.chunk", "part.offset")
    return (
        f"flatten(transform(arrays_zip({chunks} as chunk, slice({offsets}, 1, size({lengths}) div {_CHUNK} + 1)"
        f" as offset), part -> {sums}))"
    ).replace(" as chunk", "").replace(" as offset", "").replace("part.chunk", "part.`0`").replace(
        "part.offset", "part.`1`"
    )


def _valid(kind: int, value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == 1:
        part = "ltrim('0', p)"
        return (
            f"forall(split({value}, '[.]'), p -> char_length({part}) <= 3"
            f" AND coalesce(try_cast({part} AS INT), 0) <= 255)"
        )
    if kind == 2:
        luhn = (
            f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> CAST(d AS INT) * (1 + i % 2)),"
            " 0, (sum, x) -> sum + IF(x > 9, x - 9, x)) % 10 = 0"
        )
        return f"IF(char_length({digits}) BETWEEN 14 AND 19, {luhn}, false)"
    if kind == 3:
        return f"char_length({digits}) BETWEEN 10 AND 15"
    return "true"


def find_entities(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, found) with found an array of (start, kind, end, value, before, after, cut).

    `kind` is the index in KINDS, positions are code points with exclusive ends,
    in the order of start and kind; `before` and `after` are the nearest CONTEXT
    characters up to the next match of the kind, `cut_before` and `cut_after` say
    whether there was more.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    may = {0: "contains(text, '@')", 3: "contains(text, '+')"}
    columns = ["doc_id", "text_hash"]
    for kind, pattern in enumerate(PATTERNS):
        p = "r'" + pattern + "'"
        test = may.get(kind, "true")
        columns.append(f"IF({test}, regexp_extract_all(text, {p}, 0), array()) AS m{kind}")
    rows = rows.selectExpr("text", *columns)
    columns = ["doc_id", "text_hash", *(f"m{k}" for k in range(4))]
    for kind, pattern in enumerate(PATTERNS):
        columns.append(f"IF(size(m{kind}) > 0, split(text, r'{pattern}', -1), array('')) AS g{kind}")
    rows = rows.selectExpr(*columns)
    for kind in range(4):
        rows = rows.withColumn(
            f"l{kind}", F.expr(f"transform(m{kind}, (x, i) -> CAST(char_length(g{kind}[i]) + char_length(x) AS BIGINT))")
        ).withColumn(f"e{kind}", F.expr(_running(f"l{kind}")))
    parts = []
    for kind in range(4):
        g = f"g{kind}"
        span = (
            f"transform(m{kind}, (x, i) -> named_struct('start', e{kind}[i] - char_length(x), 'kind', {kind},"
            f" 'end', e{kind}[i], 'value', x, 'before', right({g}[i], {CONTEXT}),"
            f" 'cut_before', char_length({g}[i]) > {CONTEXT}, 'after', left({g}[i + 1], {CONTEXT}),"
            f" 'cut_after', char_length({g}[i + 1]) > {CONTEXT}))"
        )
        parts.append(f"filter({span}, s -> {_valid(kind, 's.value')})")
    return rows.selectExpr("doc_id", "text_hash", f"array_sort(concat({', '.join(parts)})) AS found")


def _terms(side: str, cut: str, drop: str, origin: str) -> str:
    """SQL for the terms of one side of an entity, an array of (term, start, end); a term cut off by the window is left out."""
    words = f"regexp_extract_all({side}, r'{_TERM}', 0)"
    gaps = f"split({side}, r'{_TERM}', -1)"
    edge = f"element_at({gaps}, {drop}) = ''"
    ends = (
        f"slice(aggregate(transform({words}, (w, i) -> char_length({gaps}[i]) + char_length(w)), array(0),"
        f" (sums, x) -> concat(sums, array(element_at(sums, -1) + x))), 2, size({words}))"
    )
    at = "w.`1`"
    spans = (
        f"transform(arrays_zip({words}, {ends}), w -> named_struct('term', lower(w.`0`),"
        f" 'start', {origin} + {at} - char_length(w.`0`), 'end', {origin} + {at}))"
    )
    kept = f"slice({spans}, {'2' if drop == '1' else '1'}, greatest(size({words}) - 1, 0))"
    return f"IF({cut} AND {edge}, {kept}, {spans})"


def near_terms(entities: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, entity, term, start, end), one per term near an entity.

    Terms that overlap an entity are left out, no others: a short word or a number may disclose as much.
    """
    one = entities.where(F.size("found") > 0).select(
        "doc_id", "text_hash",
        F.transform("found", lambda s: F.struct(s["start"], s["end"])).alias("taken"),
        F.explode("found").alias("s"),
    ).selectExpr(
        "doc_id", "text_hash", "taken", "concat(s.kind, ':', lower(s.value)) AS entity", "s.start AS s_start",
        "s.end AS s_end", "s.before AS before", "s.after AS after", "s.cut_before AS cut_before",
        "s.cut_after AS cut_after",
    )
    both = one.selectExpr(
        "doc_id", "text_hash", "taken", "entity",
        "explode(concat("
        + _terms("before", "cut_before", "1", "s_start - char_length(before)")
        + ", " + _terms("after", "cut_after", "-1", "s_end") + ")) AS t",
    )
    return both.where("NOT exists(taken, e -> e.start < t.end AND t.start < e.end)").selectExpr(
        "doc_id", "text_hash", "entity", "t.term AS term", "t.start AS start", "t.end AS end"
    )


def disclosure(docs: DataFrame, entities: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (entity, term, together, disclosed): the part of an entity's information that a term gives away.

    All are counts of the whole corpus: occurrences of a term near the entity
    and anywhere, mentions of the entity, and words. Pairs met once count like
    others. Only (entity, term) sums and term sums are shuffled.
    """
    together = near.groupBy("entity", "term").agg(F.count("*").alias("together"))
    words = docs.select(
        F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")).alias("term")
    ).where("term <> ''")
    counts = materialize(words.groupBy("term").agg(F.count("*").alias("anywhere")), "pii-terms")
    total = counts.agg(F.coalesce(F.sum("anywhere"), F.lit(1))).first()[0]
    mentions = (
        entities.select(F.explode("found").alias("s"))
        .groupBy(F.expr("concat(s.kind, ':', lower(s.value))").alias("entity"))
        .agg(F.count("*").alias("mentions"))
    )
    share = F.least(F.lit(1.0), F.col("together") / F.col("anywhere"))
    information = -F.log2(F.least(F.col("mentions") / F.lit(float(total)), F.lit(0.5)))
    return (
        together.join(counts, "term").join(mentions, "entity")
        .select("entity", "term", "together", (1 + F.log2(share) / information).alias("disclosed"))
    )


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """Rows (doc_id, text_hash, spans), one per document: spans of (start, kind, end, value, disclosed).

    Entities disclose 1. A null or empty text has no spans. Rows equal in id and
    text have equal spans; a null id is kept; other columns are ignored; an empty
    table gives an empty result.
    """
    entities = materialize(find_entities(docs), "pii-entities")
    near = materialize(near_terms(entities), "pii-near")
    told = disclosure(docs, entities, near).where(F.col("disclosed") >= generalise)
    terms = (
        near.join(told, ["entity", "term"])
        .groupBy("doc_id", "text_hash", "start", "end")
        .agg(F.max("disclosed").alias("disclosed"), F.min("term").alias("term"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_list(
                F.struct("start", F.lit(4).alias("kind"), "end", F.col("term").alias("value"), "disclosed")
            ).alias("terms")
        )
        .select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "terms")
    )
    plain = entities.select(
        "doc_id", "text_hash",
        F.expr(
            "transform(found, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end,"
            " 'value', s.value, 'disclosed', 1.0D))"
        ).alias("plain"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash"))
    spans = F.array_sort(F.concat("plain", F.coalesce("terms", F.array())))
    return plain.join(terms, same, "left").select("doc_id", "text_hash", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """`docs` with its text sanitised: entities become their kind, terms their initial, or nothing beyond `remove`.

    Of overlapping spans the first counts. Null texts stay null.
    """
    found = find_personal_data(docs, **options).dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")
    )
    names = "array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]')"
    text = (
        "aggregate(_spans, named_struct('text', '', 'at', 0L), (acc, s) -> IF(s.start < acc.at, acc, named_struct("
        "'text', concat(acc.text, substring(text, CAST(acc.at + 1 AS INT), CAST(s.start - acc.at AS INT)),"
        f" IF(s.kind < 4, {names}[least(s.kind, 3)], IF(s.disclosed >= {remove}, '', concat(left(s.value, 1), '.')))),"
        " 'at', s.end)), acc -> concat(acc.text, substring(text, CAST(acc.at + 1 AS INT))))"
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "text"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    cleaned = F.when(F.col("text").isNull(), None).otherwise(F.expr(text))
    return rows.join(found, same, "left").select(
        *((cleaned if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns)
    )
