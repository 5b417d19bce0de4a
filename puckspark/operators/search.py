"""Name lookups, suggestions, comp filters and guarded read-only SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the read-only guard.
ROW_LIMIT = 200
BLOCKED_WORDS = [
    "insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "grant",
    "revoke", "call", "execute", "begin", "commit", "rollback", "export", "load",
]
# Functions a served query may call: those that only look at their arguments.
FUNCTIONS = set("""
    abs acos add_months any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max array_min
    array_size array_sort asin atan atan2 avg bool_and bool_or bround cast cbrt ceil ceiling char_length coalesce collect_list collect_set concat
    concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date date date_add date_diff date_format date_sub date_trunc
    datediff day dayofmonth dayofweek decode degrees dense_rank element_at endswith every exp explode extract first first_value flatten floor format_number
    format_string from_unixtime greatest grouping grouping_id hour if ifnull initcap instr isnotnull isnull kurtosis lag last last_day last_value lcase
    lead least left len length levenshtein ln locate log log10 log2 lower lpad ltrim make_date map max max_by mean median min min_by minute mod mode
    month months_between named_struct next_day now nth_value ntile nullif nvl nvl2 overlay percent_rank percentile percentile_approx percentile_cont
    percentile_disc pi pmod position posexplode pow power quarter radians rank regexp_count regexp_extract regexp_like regexp_replace regexp_substr
    regr_slope repeat replace reverse right round row_number rpad rtrim second sequence sign signum sin size skewness slice split split_part sqrt
    startswith std stddev stddev_pop stddev_samp string struct substr substring substring_index sum tan timestamp to_date to_timestamp transform translate
    trim trunc try_add try_divide try_element_at try_subtract typeof ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket year
""".split())
# Words that may stand before a bracket without being a function.
_GRAMMAR = set("""
    select from where and or not in on using over filter as by when then else values exists join union all lateral between like ilike rlike case having
    within group partition interval distinct any some limit offset sets rollup cube except intersect minus is order with unnest inline table pivot unpivot for
    int bigint double float decimal numeric char varchar
""".split())
_TOKEN = re.compile(r"""
    (?P<text>[rR]?'(?:\\.|[^'\\])*'|[rR]?"(?:\\.|[^"\\])*")|(?P<comment>--|/\*)|(?P<quoted>`(?:[^`]|``)*`)
    |(?P<word>[A-Za-z_]\w*)|(?P<space>\s+)|(?P<other>.)""", re.X | re.S)


def find_by_id(df: DataFrame, key: str, value: int, season: str, season_id: int) -> DataFrame:
    return df.filter((F.col(season) == season_id) & (F.col(key) == value))


def find_by_name(df: DataFrame, name: str, query: str, weight: str, key: str, n: int = 5) -> DataFrame:
    """Case-insensitive substring match, heaviest first."""
    hit = F.contains(F.lower(name), F.lower(F.lit(query)))
    return df.filter(hit).orderBy(F.desc(weight), key).limit(n)


def folded(c: Column) -> Column:
    """Compare without case or accents."""
    return F.collate(c, "UNICODE_CI_AI")


def suggest(df: DataFrame, name: str, query: str, key: str, n: int = 8) -> DataFrame:
    """Names with a part starting with the query first, then names containing it."""
    q = query.strip()
    if len(q) < 2:
        return df.withColumn("tier", F.lit(1)).limit(0)
    needle = folded(F.lit(q))
    # split before collating: split takes no collated text
    parts = F.split(F.col(name), r"[\s-]+")
    part_hit = F.exists(parts, lambda p: F.startswith(folded(p), needle))
    first = part_hit | F.startswith(folded(F.col(name)), needle)
    tier = F.when(first, 1).when(F.contains(folded(F.col(name)), needle), 2)
    return df.withColumn("tier", tier).filter("tier is not null").orderBy("tier", name, key).limit(n)


def age_band(comps: DataFrame, age: str, subject_age: str, rank: str, band: int = 3, n: int = 10) -> DataFrame:
    """Comps within ``band`` years of the subject; rows with an unknown age drop out."""
    near = F.abs(F.col(age) - F.col(subject_age)) <= band
    return comps.filter(near).orderBy(rank).limit(n)


def compare_profiles(df: DataFrame, key: str, a, b, axes: dict[str, str]) -> DataFrame:
    """Two entities side by side on {column: label}; a missing value counts as 0."""
    pair = df.filter(F.col(key).isin(a, b))
    long = pair.select(key, F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("axis"), F.col(c).cast("double").alias("v"))
        for i, (c, label) in enumerate(axes.items())
    ])))
    side = lambda who: F.coalesce(F.max(F.when(F.col(key) == who, F.col("v"))), F.lit(0.0))
    return long.groupBy("position", "axis").agg(side(a).alias("a"), side(b).alias("b")).orderBy("position")


def _refuse(reason: str):
    raise ValueError(reason)


def check_select(sql: str, marts: str = "nhl_marts", hidden=("nhl_raw", "nhl_stg", "information_schema")) -> str:
    """The trimmed text if it looks like one read-only statement over the marts, else ValueError.

    Texts are taken apart first, so a name inside a string does not count as a table or a function; blocked words do
    not pass even there. Which tables it really reads is for ``run_select`` to see.
    """
    text = sql.strip()
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]
    code = [(k, t.lower()) for k, t in tokens if k != "space"]
    kinds, said = {k for k, _ in code}, set(re.findall(r"\w+", text.lower()))
    if not code or code[0] not in (("word", "select"), ("word", "with")):
        _refuse("the text must be a SELECT")
    if "comment" in kinds or any(t == ";" for k, t in code if k == "other") or ";" in text:
        _refuse("one statement, without semicolons or comments")
    if any(t in ("'", '"', "`") for k, t in code if k == "other"):
        _refuse("a quote is not closed")
    for word in BLOCKED_WORDS:
        if word in said:
            _refuse(f"keyword not allowed: {word}")
    for schema in hidden:
        if schema.lower() in said:
            _refuse(f"schema not allowed: {schema}")
    plain = [(k, t.strip("`")) for k, t in code]
    for (kind, name), after in zip(plain, [*plain[1:], ("", "")]):
        if kind == "quoted" and re.search(r"[/:\\]", name):
            _refuse("files can't be read")
        if after[1] == "(" and (kind == "quoted" and name not in FUNCTIONS or kind == "word" and name not in FUNCTIONS | _GRAMMAR):
            _refuse(f"function not allowed: {name}")
    if not any(a[1] == marts.lower() and b[1] == "." for a, b in zip(plain, plain[1:]) if a[0] != "text"):
        _refuse(f"queries must read {marts}.<table>")
    return text


# Plan leaves that read no stored table, and leaf expressions that look at nothing but the row, the plan or the clock.
_PLAIN_LEAVES = {"CTERelationRef", "OneRowRelation", "LocalRelation"}
_PLAIN_EXPRESSIONS = set("""
    AttributeReference Literal NamedLambdaVariable CurrentDate CurrentTimestamp Now LocalTimestamp Pi EulerNumber RowNumber CumeDist UnboundedPreceding$ CurrentRow$
    UnboundedFollowing$ ScalarSubquery ListQuery Exists LateralSubquery GroupingID LateralColumnAliasReference Rank DenseRank PercentRank
""".split())


class PlanFacts:
    """Relations and context functions of an analysed plan, read off Spark's own description of it in one call; no file is listed.

    ``relations`` holds (database, name) of every view or table that the plan reads, whatever the text calls it, and ("", kind) of every
    other source: temporary views, files, generated ranges. What lies below a named view is the view's own affair.
    ``context`` holds the kinds of leaf expressions that look beyond the row, such as the user, with or without brackets.
    """

    def __init__(self, df: DataFrame):
        self.relations: set[tuple[str, str]] = set()
        self.context: set[str] = set()
        self._plan(json.loads(df._jdf.queryExecution().analyzed().toJSON()), 0)

    def _skip(self, nodes: list, at: int) -> int:
        left = 1
        while left:
            left += nodes[at]["num-children"] - 1
            at += 1
        return at

    def _plan(self, nodes: list, at: int) -> int:
        node, after = nodes[at], at + 1
        kind = node["class"].rsplit(".", 1)[-1]
        if kind == "View":
            name = node["desc"]["identifier"]
            self.relations.add(("", "a temporary view") if node["isTempView"] else (name.get("database") or "", name["table"]))
            return self._skip(nodes, at)
        if kind == "SubqueryAlias" and nodes[after]["class"].endswith("LogicalRelation"):
            name = node["identifier"]
            qualifier = name["qualifier"].strip("[]").split(", ") if isinstance(name["qualifier"], str) else name["qualifier"]
            self.relations.add((qualifier[-1], name["name"]) if qualifier and qualifier[-1] else ("", "a file"))
            return self._skip(nodes, at)
        if node["num-children"] == 0 and kind not in _PLAIN_LEAVES:
            self.relations.add(("", kind))
        self._fields(node)
        for _ in range(node["num-children"]):
            after = self._plan(nodes, after)
        return after

    def _fields(self, node: dict) -> None:
        for value in node.values():
            self._value(value)

    def _value(self, value) -> None:
        if not isinstance(value, list) or not value:
            return
        if not (isinstance(value[0], dict) and "class" in value[0]):
            for v in value:
                self._value(v)
            return
        if "num-children" in value[0] and re.search(r"\.(logical|datasources)\.", value[0]["class"]):
            self._plan(value, 0)  # the plan of a subquery
            return
        for expression in value:
            kind = expression["class"].rsplit(".", 1)[-1]
            if expression.get("num-children") == 0 and kind not in _PLAIN_EXPRESSIONS:
                self.context.add(kind)
            self._fields(expression)


def run_select(
    spark: SparkSession, sql: str, args: dict | None = None, max_rows: int | None = ROW_LIMIT, marts: str = "nhl_marts"
) -> DataFrame:
    """Guarded SELECT with named parameters (``:name``). The text names tables as ``marts.table``; see ``sinks.register``.

    Besides ``check_select``, every relation of the analysed plan must be a name of ``marts``, and nothing in it may look at its
    surroundings. At most ``max_rows`` rows are returned; a caller who must know whether there are more asks for one row
    beyond its page, or for None (all).
    """
    found = spark.sql(check_select(sql, marts), args=args or {})
    facts = PlanFacts(found)
    foreign = sorted(f"{database}.{name}".lstrip(".") for database, name in facts.relations if database.lower() != marts.lower())
    if foreign:
        _refuse(f"only tables of {marts} can be read, not {', '.join(foreign)}")
    if facts.context:
        _refuse(f"function not allowed: {', '.join(sorted(facts.context))}")
    return found if max_rows is None else found.limit(max_rows)
