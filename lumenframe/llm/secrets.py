"""Secret scans: base patterns, and sliding-window entropy of candidate strings per character class.

Everything here is DataFrame functions. Candidates are runs of characters as keys are written in. A window of
``WINDOW`` characters slides over a candidate; the counts of the characters in the window, and the sum of
c * log2(c) over them, are updated by the character that enters and the one that leaves, so the Shannon entropy
log2(WINDOW) - sum / WINDOW of every window is had at the cost of an update. A candidate is a secret if some window
reaches the entropy of its class (hexadecimal, or the larger base-64 alphabet) and the allow-list does not name it.
Candidates shorter than a window are one window of their own length. Base spans are cut out of a run, and what remains
is judged by itself; a run that holds a stand-in's word loses the segments (between signs) with such words, not more.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The base patterns, with the group whose length counts and the least length. Runs that are too short for
# access and hex are not matched at all, which gives the same matches: a run's first match is its longest.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A pattern that every useful match of a kind contains or is, to pass over texts without one quickly.
PRESENT = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

WINDOW = 24
#: Least length of a candidate; those below ``WINDOW`` are judged whole.
SHORTEST = 16
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Alphabet and least entropy, in bits, of the classes.
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 2.9),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.7),
}
HEX_ONLY = r"^[0-9a-fA-F]+$"
#: Candidates that are never secrets: without a digit or without a letter; words and numbers joined by signs; UUIDs;
#: stand-ins written for examples.
ALLOWED = (
    r"^[^0-9]+$", r"^[^A-Za-z]+$", r"^([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx|your[_-]?|0123456789|1234567890|abcdefgh",
)
#: Segments without a stand-in's word, joined by signs.
_SEGMENT = r"(?<![A-Za-z0-9])(?![A-Za-z0-9]*(?:" + ALLOWED[-1].removeprefix("(?i)").replace("[_-]?", "") + r"))[A-Za-z0-9]++"
UNNAMED = rf"(?i){_SEGMENT}(?:[+/_=-]++{_SEGMENT})*+=*+"
ORDER = [*BASE, *CLASSES]

#: c * log2(c) in millionths, for counts up to a window; whole numbers so that sums are exact.
WEIGHTS = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1)]


SPAN = "struct<start:int,end:int,value:string>"
#: Entries of an array that are folded at a time.
SLICE = 128


def _gathered(entries: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str = SPAN) -> Column:
    """What ``step`` puts out over the entries, in order: a fold in slices.

    ``step`` takes the state, as in ``first``, and an entry, and gives the next state and an array of what it puts out. An array
    that grows by one entry a step is copied at every step; by slices, copies stay short however many entries there are.
    """
    empty = F.array().cast(f"array<{kind}>")

    def within(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["out"], out.cast(f"array<{kind}>")).alias("out"))

    def over(s: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(s["state"].alias("state"), empty.alias("out")), within, lambda t: F.struct(
            t["state"].alias("state"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / SLICE).cast("int")),
                         lambda k: F.slice(entries, k * SLICE + 1, F.lit(SLICE)))
    start = F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(entries) > 0, F.aggregate(slices, start, over, lambda s: F.flatten(s["out"]))).otherwise(empty)


def _found(text: Column, pattern: str, group: int, present: str) -> Column:
    """Matches in order: array<struct<start, end, value>>, in code points; the value is the group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.coalesce(end, at), F.when(x["whole"].isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(own)

    # The entries are a variable of the fold: as an expression they would be computed anew for every slice.
    found = F.flatten(F.transform(F.array(both), lambda entries: _gathered(entries, F.lit(0), step)))
    return F.when(text.rlike(present), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _least_sum(value: Column, alphabet: str) -> Column:
    """The smallest sum of c * log2(c), in millionths, over all windows (a shorter value is one): that of the largest entropy."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    place = lambda i: F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1)))
    counted = lambda counts, k: F.element_at(counts, k)

    def step(state: Column, i: Column) -> Column:
        enters, leaves = place(i), F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(0))
        more = F.when(enters == leaves, F.lit(0)).otherwise(
            F.element_at(weights, counted(state["counts"], enters) + 2) - F.element_at(weights, counted(state["counts"], enters) + 1))
        less = F.when((leaves == 0) | (enters == leaves), F.lit(0)).otherwise(
            F.element_at(weights, counted(state["counts"], F.greatest(leaves, F.lit(1))))
            - F.element_at(weights, counted(state["counts"], F.greatest(leaves, F.lit(1))) + 1))
        total = state["sum"] + more + less
        counts = F.transform(state["counts"], lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0))
        least = F.when(i >= F.least(F.lit(WINDOW), F.length(value)), F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.cast("int").alias("sum"), least.cast("int").alias("least"))

    first = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), first, step, lambda s: s["least"])


def most_of(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c * log2(c), in millionths, of a window with at least this entropy."""
    return round((math.log2(window) - bits) * window * 1e6)


def _allowed(value: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value.rlike(p), True) for p in patterns], F.lit(False))


def _within(x: Column, start: Column, end: Column) -> Column:
    """The part of a span between two places."""
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                    F.substring(x["value"], start - x["start"] + 1, end - start).alias("value"))


def _parts(x: Column, pattern: str) -> Column:
    """The matches of a pattern in a span, as spans of the text."""
    return F.transform(_found(x["value"], pattern, 0, pattern), lambda y: F.struct(
        (x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["value"].alias("value")))


def _remains(runs: Column, base: Column) -> Column:
    """What the spans of ``base`` leave of the runs, which do not overlap: both lists are merged by start and folded once.

    The state is the present run and the place from which it is open; ``end`` is the end of all base spans so far.
    """
    none = F.lit(None).cast(SPAN)
    events = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].cast("int").alias("start"), F.lit(0).alias("run"), b["end"].cast("int").alias("end"), none["value"].alias("value"))),
        F.transform(runs, lambda x: F.struct(x["start"].cast("int").alias("start"), F.lit(1).alias("run"), x["end"].cast("int").alias("end"), x["value"].alias("value"))),
        # A last event closes the last run.
        F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(1).alias("run"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("value")))))

    def step(s: Column, e: Column) -> tuple[Column, Column]:
        run, to = s["run"], F.least(e["start"], s["run"]["end"])
        piece = F.when(run.isNotNull() & (to > s["at"]), F.array(_within(run, s["at"], to))).otherwise(F.array().cast(f"array<{SPAN}>"))
        opens = e["run"] == 1
        end = F.when(opens, s["end"]).otherwise(F.greatest(s["end"], e["end"]))
        own = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"))
        return F.struct(F.when(opens, own).otherwise(run).alias("run"),
                        F.when(opens, F.greatest(e["start"], end)).otherwise(F.greatest(s["at"], e["end"])).alias("at"), end.alias("end")), piece

    first = F.struct(none.alias("run"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    return F.flatten(F.transform(F.array(events), lambda entries: _gathered(entries, first, step)))


def _judged(x: Column) -> Column:
    """The run, or the parts of a run with stand-ins that do not name one; parts below a window only as one segment."""
    parts = F.flatten(F.transform(_parts(x, UNNAMED), lambda y: F.when(F.length(y["value"]) >= WINDOW, F.array(y)).otherwise(
        _parts(y, rf"[A-Za-z0-9]{{{SHORTEST},}}"))))
    return F.when(x["value"].rlike(ALLOWED[-1]), parts).otherwise(F.array(x))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``secrets`` of every row: array<struct<start, rank, kind, end>>, by start and then kind.

    Places are code points, ``end`` exclusive. ``rank`` is the kind's place in ORDER. Base kinds may overlap; of a
    high-entropy string that overlaps a base secret only the rest is judged and reported. A null or empty text has no secrets; ids are
    passed on as they are, null and repeated ones too; only the named columns are read; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = "array<struct<start:int,rank:int,kind:string,end:int>>"

    def spans(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(span)

    def long_enough(least: int):
        return lambda x: F.length(x["value"]) >= least

    base = [spans(F.filter(_found(F.col("t"), pattern, group, PRESENT[kind]), long_enough(least)), kind)
            for kind, (pattern, group, least) in BASE.items()]
    rows = docs.select(F.col(id_col), text.alias("t")).select(
        id_col, F.concat(*base).alias("base"), _found(F.col("t"), "(?<![A-Za-z0-9+/_-])" + RUN, 0, RUN).alias("candidates"))
    strange = lambda x: (F.length(x["value"]) >= SHORTEST) & ~_allowed(x["value"], ALLOWED)
    named = lambda x: (F.length(x["value"]) >= SHORTEST) & ~_allowed(x["value"], ALLOWED[:-1])
    rows = rows.withColumn("candidates", _remains(F.col("candidates"), F.col("base")))
    rows = rows.withColumn("candidates", F.flatten(F.transform(F.filter("candidates", named), _judged)))
    rows = rows.withColumn("candidates", F.filter("candidates", strange))
    found = []
    for kind, (alphabet, bits) in CLASSES.items():
        own = lambda x, hexadecimal=kind == "entropy_hex": x["value"].rlike(HEX_ONLY) == hexadecimal
        limits = F.array(*[F.lit(most_of(bits, w)) for w in range(SHORTEST, WINDOW + 1)])
        most = lambda x, limits=limits: F.element_at(limits, F.least(F.length(x["value"]), F.lit(WINDOW)) - SHORTEST + 1)
        value = (lambda x: F.lower(x["value"])) if kind == "entropy_hex" else (lambda x: x["value"])
        found.append(spans(F.filter("candidates", lambda x: own(x) & (_least_sum(value(x), alphabet) <= most(x))), kind))
    return rows.select(id_col, F.array_sort(F.concat("base", *found)).alias("secrets"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every row of documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_base = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(of_base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


def _kind_sql(name: str, rank: int, pattern: str, group: int, least: int, source: str = "t") -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT id, {rank} AS rank, '{name}' AS kind, gap_sum + whole_sum - length(whole) AS start, gap_sum + whole_sum AS stop, whole, value
  FROM (SELECT id, whole, value, sum(length(gap)) OVER w AS gap_sum, sum(length(whole)) OVER w AS whole_sum
        FROM (SELECT id, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS whole,
                     unnest(regexp_extract_all(t, '{pattern}', {group})) AS value, unnest(range(length(t) + 2)) AS k FROM {source})
        WINDOW w AS (PARTITION BY id ORDER BY k))
  WHERE whole IS NOT NULL AND length(value) >= {least}"""


def _sql() -> str:
    kinds = " UNION ALL ".join(_kind_sql(kind, ORDER.index(kind), p, g, n) for kind, (p, g, n) in BASE.items())
    never = lambda value, patterns: " OR ".join(f"regexp_matches({value}, '{p}')" for p in patterns)
    names = ALLOWED[-1].replace("[_-]?", "")
    weight = f"list_extract([{', '.join(map(str, WEIGHTS))}], (n + 1)::INTEGER)"
    limit = lambda kind: f"list_extract([{', '.join(str(most_of(CLASSES[kind][1], w)) for w in range(SHORTEST, WINDOW + 1))}], w - {SHORTEST - 1})"
    hex_rank, other_rank = ORDER.index("entropy_hex"), ORDER.index("entropy_base64")
    return rf"""
WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
base AS ({kinds}),
run AS (SELECT id, start, stop, whole FROM ({_kind_sql("run", 0, RUN, 0, 0)}) r),
edge AS (
  SELECT r.id, r.start AS run_start, r.whole, b.start AS cut, b.stop AS resume
  FROM run r JOIN base b ON b.id = r.id AND b.start < r.stop AND b.stop > r.start
  UNION ALL SELECT id, start, whole, stop, stop FROM run),
open AS (
  SELECT id, run_start, whole, cut, greatest(run_start, coalesce(max(resume) OVER (
           PARTITION BY id, run_start ORDER BY cut, resume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), run_start)) AS start
  FROM edge),
piece AS (
  SELECT id, start::BIGINT AS start, s FROM (
    SELECT id, start, substring(whole, (start - run_start + 1)::BIGINT, (cut - start)::BIGINT) AS s FROM open WHERE cut - start >= {SHORTEST}) p
  WHERE NOT ({never("s", ALLOWED[:-1])})),
stand AS (SELECT {{'id': id, 'start': start}} AS id, s AS t FROM piece WHERE regexp_matches(s, '{ALLOWED[-1]}')),
segment AS (
  SELECT id, start, stop, named, sum(named::INTEGER) OVER (PARTITION BY id ORDER BY start) AS part
  FROM (SELECT id, start, stop, regexp_matches(whole, '{names}') AS named FROM ({_kind_sql("s", 0, "[A-Za-z0-9]+", 0, 0, "stand")}) g) m),
joined AS (
  SELECT g.id, g.a, substring(t, g.a + 1, g.b - g.a) || regexp_extract(substring(t, g.b + 1), '^=*') AS s
  FROM (SELECT id, min(start)::BIGINT AS a, max(stop)::BIGINT AS b FROM segment WHERE NOT named GROUP BY id, part) g JOIN stand ON stand.id = g.id),
short AS (SELECT id, a, s, regexp_extract(s, '[A-Za-z0-9]{{{SHORTEST},}}') AS own FROM joined WHERE length(s) < {WINDOW}),
judged AS (
  SELECT id, start, s FROM piece WHERE NOT regexp_matches(s, '{ALLOWED[-1]}')
  UNION ALL SELECT id.id, id.start + a, s FROM joined WHERE length(s) >= {WINDOW}
  UNION ALL SELECT id.id, id.start + a + strpos(s, own) - 1, own FROM short WHERE own <> ''),
candidate AS (
  SELECT id, start, start + length(s) AS stop, least({WINDOW}, length(s)) AS w, regexp_matches(s, '{HEX_ONLY}') AS is_hex,
         CASE WHEN regexp_matches(s, '{HEX_ONLY}') THEN lower(s) ELSE s END AS s
  FROM judged WHERE length(s) >= {SHORTEST} AND NOT ({never("s", ALLOWED)})),
win AS (SELECT id, start, stop, w, is_hex, o, substring(s, o + p, 1) AS ch
        FROM (SELECT *, unnest(range(0, length(s) - w + 1)) AS o FROM candidate), range(1, {WINDOW} + 1) r(p) WHERE p <= w),
cnt AS (SELECT id, start, stop, w, is_hex, o, ch, count(*) AS n FROM win GROUP BY ALL),
ent AS (SELECT id, start, stop, w, is_hex, o, sum({weight}) AS total FROM cnt GROUP BY ALL),
extra AS (
  SELECT id, CASE WHEN is_hex THEN {hex_rank} ELSE {other_rank} END AS rank,
         CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind, start, stop
  FROM ent GROUP BY id, start, stop, w, is_hex
  HAVING min(total) <= CASE WHEN is_hex THEN {limit("entropy_hex")} ELSE {limit("entropy_base64")} END),
every AS (SELECT id, rank, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM base UNION ALL SELECT id, rank, kind, start, stop FROM extra),
line AS (SELECT id, rank, start, kind || ':' || start || ':' || stop AS s, kind FROM every),
agg AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS b,
         string_agg(s, ',' ORDER BY start, rank) AS spans FROM line GROUP BY id)
SELECT t.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN agg ON t.id = agg.id
"""


SQL = _sql()
