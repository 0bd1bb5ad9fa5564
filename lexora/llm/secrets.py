"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text: the base kinds ``assign``, ``access`` and ``hex``, and
``token``, a run of 20 or more ASCII letters and digits that mixes upper case, lower case and
digits. The hash of each candidate's secret value is aggregated over the corpus by distinct
repositories and distinct owners. A value held by more than ``max_owners`` owners, or in more than
``max_repositories`` repositories, is a widely copied example; any other that has
``LEAST_DISTINCT`` distinct characters looks live. Base spans
are always reported. A token span is added where its value looks live and no base span overlaps
it. Owners come from ``source`` and repositories from ``source`` and ``lang`` unless named.

Spans are counted in code points, end exclusive. Matches of a kind are leftmost and do not
overlap; a match that is too short is dropped, not shortened or retried. Positions come from the
lengths of the matches and of the text between them, so nothing leaves the JVM.

Defined cases: a null text counts as empty; an empty text has no spans, and its base_sha256 is
that of the empty string. Rows that repeat a doc_id, or have none, are scanned on their own.
A null owner or repository counts as one unnamed owner or repository. Extra columns are ignored.
Ownership is counted on distinct (hash, repository, owner) rows, combined before the shuffle, so
a secret that a third of the corpus holds costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.session import cut

#: Kind, pattern, group that holds the secret, least characters of that group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("token", r"[A-Za-z0-9]+", 0, 20),
]
BASE = 3
LEAST_DISTINCT = 10
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
MASK = "[SECRET]"

#: Cheap tests that a text must pass to hold a match that counts: the same runs, long enough.
_GATES = {
    "assign": KINDS[0][1],
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "token": r"[A-Za-z0-9]{20}",
}
#: For the kinds that are maximal runs, a least length in the pattern finds the same matches and skips the short ones.
_PATTERNS = {
    "assign": KINDS[0][1],
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "token": r"[A-Za-z0-9]{20,}",
}
_SPAN = "struct<start:int,rank:int,end:int,value:string>"


#: Items whose running value is built together.
_CHUNK = 64


def _running(df: DataFrame, name: str, values: Column, start: int, join) -> DataFrame:
    """Adds the array ``name``: at each place the values up to it, joined (sums, or greatest).

    Values are joined by chunks first, so the cost of a long array is far from its square.
    """
    chunk = lambda c: F.slice(name, c * _CHUNK + 1, F.lit(_CHUNK))
    fold = lambda xs: F.aggregate(xs, F.lit(start).cast("long"), join)
    df = df.withColumn(name, F.transform(values, lambda v: v.cast("long")))
    many = F.ceil(F.size(name) / _CHUNK).cast("int")
    indices = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    df = df.withColumn(f"{name}_chunks", F.transform(indices, lambda c: fold(chunk(c))))
    own = lambda i: fold(F.slice(name, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK + 1))
    before = lambda i: fold(F.slice(f"{name}_chunks", F.lit(1), F.floor(i / _CHUNK).cast("int")))
    return df.withColumn(name, F.transform(name, lambda _, i: join(before(i), own(i)))).drop(f"{name}_chunks")


def _with_spans(rows: DataFrame, rank: int) -> DataFrame:
    """Adds ``kind<rank>``, the spans of one kind in ``text``, in order."""
    kind, _, group, least = KINDS[rank]
    text, pattern = F.col("text"), F.lit(_PATTERNS[kind])
    empty = F.expr("cast(array() as array<string>)")
    held = text.rlike(_GATES[kind])
    names = {c: f"{c}{rank}" for c in ("whole", "value", "gap", "end", "kind")}
    rows = rows.withColumn(names["whole"], F.when(held, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(empty))
    found = F.size(names["whole"]) > 0
    value = F.col(names["whole"]) if group == 0 else F.when(found, F.regexp_extract_all(text, pattern, F.lit(group))).otherwise(empty)
    gap = F.when(found, F.slice(F.split(text, _PATTERNS[kind], -1), F.lit(1), F.size(names["whole"]))).otherwise(empty)
    rows = rows.withColumns({names["value"]: value, names["gap"]: gap})
    rows = _running(rows, names["end"], F.zip_with(names["gap"], names["whole"], lambda g, w: F.length(g) + F.length(w)), 0, lambda a, b: a + b)
    each = F.transform(
        F.arrays_zip(F.col(names["whole"]).alias("whole"), F.col(names["value"]).alias("value"), F.col(names["end"]).alias("end")),
        lambda x: F.struct((x["end"] - F.length(x["whole"])).cast("int").alias("start"), F.lit(rank).alias("rank"), x["end"].cast("int").alias("end"), x["value"].alias("value")),
    )

    def counts(x: Column) -> Column:
        keep = F.length(x["value"]) >= least
        if kind == "token":
            keep &= x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]")
        return keep

    return rows.withColumn(names["kind"], F.filter(each, counts)).drop(*[names[c] for c in ("whole", "value", "gap", "end")])


def _named(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: doc_id, key, owner, repository and the spans of all kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = [c for c in repository if c in docs.columns]
    who = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner in docs.columns else F.lit("")
    where = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in held]) if held else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), who.alias("owner"), where.alias("repository"))
    for rank in range(len(KINDS)):
        rows = _with_spans(rows, rank)
    return rows.select(
        "doc_id",
        F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("key"),
        "owner",
        "repository",
        F.concat(*[F.col(f"kind{rank}") for rank in range(BASE)]).alias("base"),
        F.col(f"kind{BASE}").alias("tokens"),
    )


def ownership(candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, repositories, owners, live) of each secret value in the corpus."""
    values = candidates.select("owner", "repository", F.explode(F.concat("base", "tokens")).alias("span"))
    hashed = values.select("owner", "repository", F.sha2(F.col("span.value"), 256).alias("hash"), F.size(F.array_distinct(F.split("span.value", ""))).alias("distinct"))
    held = hashed.groupBy("hash", "repository", "owner").agg(F.max("distinct").alias("distinct"))
    return (
        held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("distinct").alias("distinct"))
        .groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("distinct").alias("distinct"))
        .select("hash", "repositories", "owners", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories) & (F.col("distinct") >= LEAST_DISTINCT)).alias("live"))
    )


def scan_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base spans, all spans, how many of its
    secret values are live-looking and how many are widely copied examples, and the most owners and
    repositories that one of its values has; ``key`` tells rows of one doc_id apart."""
    found = cut(find_candidates(docs, owner, repository))
    held = ownership(found, max_owners, max_repositories)
    hits = found.where(F.size("base") + F.size("tokens") > 0).select("doc_id", "key", "base", F.explode(F.concat("base", "tokens")).alias("span"))
    clear = ~F.exists("base", lambda b: (b["start"] < F.col("span.end")) & (F.col("span.start") < b["end"]))
    judged = hits.distinct().withColumn("hash", F.sha2(F.col("span.value"), 256)).withColumn("clear", (F.col("span.rank") == BASE) & clear).join(held, "hash")
    verdicts = judged.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
        F.collect_list(F.when(F.col("clear") & F.col("live"), F.col("span"))).alias("added"),
    )
    spans = F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)")))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.join(verdicts, found["doc_id"].eqNullSafe(verdicts["id"]) & (found["key"] == verdicts["k"]), "left").select(
        "doc_id",
        *[count(rank).alias(f"n_{KINDS[rank][0]}") for rank in range(BASE)],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_example", "most_owners", "most_repositories")],
        F.col("key"),
        spans.alias("found"),
    )


def redact_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The documents with every span reported replaced by ``MASK``; the columns stay the same.

    Overlapping spans are masked as one. n_chars, where there is such a column, follows the text
    of the documents changed; other documents are passed on as they are.
    """
    scanned = scan_secrets(docs, owner, repository, max_owners, max_repositories).where(F.size("found") > 0)
    ends = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    marks = scanned.select(F.col("doc_id").alias("id"), F.col("key").alias("own"), ends.alias("spans")).distinct()
    # What overlaps is one region: a span that starts before the end of those before it goes on with them.
    marks = _running(marks, "far", F.transform("spans", lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
    heads = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: (i == 0) | (F.col("spans")[i]["start"] >= F.col("far")[F.greatest(i - 1, F.lit(0))]))
    marks = marks.withColumn("heads", heads)
    last = lambda n: F.when(n + 1 < F.size("heads"), F.col("heads")[n + 1] - 1).otherwise(F.size("spans") - 1)
    regions = F.transform("heads", lambda i, n: F.struct(F.col("spans")[i]["start"].alias("start"), F.col("far")[last(n)].cast("int").alias("end")))
    marks = marks.select("id", "own", regions.alias("regions"))
    # The table's own columns go in one struct, so that their names cannot clash.
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("wanted"), key.alias("key"))
    joined = rows.join(marks, F.col("wanted").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own")), "left")
    text = F.col("doc")["text"]
    before = lambda n: F.when(n == 0, 0).otherwise(F.col("regions")[F.greatest(n - 1, F.lit(0))]["end"])
    kept = F.transform("regions", lambda r, n: F.concat(F.substring(text, before(n) + 1, r["start"] - before(n)), F.lit(MASK)))
    tail = F.substring(text, F.element_at("regions", -1)["end"] + 1, F.length(text))
    changed = F.col("regions").isNotNull()
    joined = joined.withColumn("clean", F.when(changed, F.concat(F.array_join(kept, ""), tail)).otherwise(text))
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("clean")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def _sql_kind(rank: int) -> str:
    kind, pattern, group, least = KINDS[rank]
    if kind == "assign":
        letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
        words = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key")
        pattern = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    else:
        pattern = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "token": "[A-Za-z0-9]{20,}"}[kind]
    mixed = " AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')" if kind == "token" else ""
    return f"""
    SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, start, start + length(whole) AS stop, value FROM (
      SELECT doc_id, source, lang, whole[i] AS whole, value[i] AS value,
        coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0)
          + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value,
          string_split_regex(text, '{pattern}') AS gap
        FROM documents WHERE regexp_matches(text, '{pattern}'))))
    WHERE length(value) >= {least}{mixed}"""


ORACLE = f"""
WITH found AS ({" UNION ALL ".join(map(_sql_kind, range(len(KINDS))))}),
held AS (
  SELECT value, count(DISTINCT source) AS owners, count(DISTINCT source || '/' || lang) AS repositories,
    count(DISTINCT source) <= {MAX_OWNERS} AND count(DISTINCT source || '/' || lang) <= {MAX_REPOSITORIES}
      AND max(len(list_distinct(string_split(value, '')))) >= {LEAST_DISTINCT} AS live
  FROM found GROUP BY value),
judged AS (
  SELECT f.*, h.live, h.owners, h.repositories, rank < {BASE} OR (h.live AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.rank < {BASE} AND b.start < f.stop AND f.start < b.stop)) AS shown
  FROM found f JOIN held h USING (value)),
per AS (
  SELECT doc_id,
    count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {BASE}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE shown) AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example,
    max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM documents d LEFT JOIN per USING (doc_id)
"""
