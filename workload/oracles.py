"""The same queries as SQL for another engine, over the same tables."""

from __future__ import annotations

from factmill import fixed_values as fixed
from factmill.plans.dashboard import TAGS
from workload.queries import DISTRICT, INFINITE_SHARES, MAJOR, NEW_NAMES, YEAR
from workload.tables import TRAIN_UNTIL, YEARS

TOKENS = ", ".join(f"'{t}'" for t in fixed.NULL_TOKENS)
KEYS = "borough, major_category, minor_category, year, month"

STAR = """
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""

FACTS = f"""
facts AS (
  SELECT n_name AS borough, p_type AS major_category, p_brand AS minor_category,
         CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
         l_quantity AS value, CAST(l_suppkey AS VARCHAR) AS lsoa_code
  {STAR})"""

DIRTY = f"""
dirty AS (
  SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN 'Unknown'
              WHEN l_orderkey % 67 = 0 THEN '  ' || lower(n_name) || ' ' ELSE n_name END
           AS borough,
         CASE WHEN l_orderkey % 61 = 0 THEN p_type || '/other of-kind' ELSE p_type END
           AS major_category,
         CASE WHEN l_orderkey % 73 = 0 THEN NULL WHEN l_orderkey % 71 = 0 THEN 'Unknown'
              ELSE p_brand END AS minor_category,
         CASE WHEN l_orderkey % 59 <> 0 THEN CAST(year(l_shipdate) AS VARCHAR) END AS year,
         CASE WHEN l_orderkey % 83 = 0 THEN '13'
              WHEN l_orderkey % 53 = 0 THEN CAST(month(l_shipdate) AS VARCHAR) || '.0'
              WHEN l_orderkey % 47 = 0 THEN CAST(month(l_shipdate) AS VARCHAR) || '.7'
              ELSE CAST(month(l_shipdate) AS VARCHAR) END AS month,
         CASE WHEN l_orderkey % 79 = 0 THEN '-5'
              WHEN l_orderkey % 43 = 0 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e0 '
              WHEN l_orderkey % 41 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'd'
              ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value,
         CAST(l_suppkey AS VARCHAR) AS lsoa_code
  {STAR})"""


def number(text: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim({text}), "
        r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN CAST(trim({text}) AS DOUBLE) END"
    )


def whole(text: str) -> str:
    value = number(text)
    return f"CASE WHEN ({value}) = floor({value}) THEN CAST({value} AS BIGINT) END"


def title(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower(trim({text})), "
        r"'\p{L}+|\P{L}+'), lambda s: upper(s[1]) || s[2:]), '')"
    )


PRESENT = " AND ".join(
    f"{c} IS NOT NULL AND {c} NOT IN ({TOKENS})"
    for c in ("borough", "major_category", "value", "year", "month")
)


def cast(source: str) -> str:
    return f"""
cast_rows AS (
  SELECT borough, major_category, minor_category, {whole('year')} AS year,
         {whole('month')} AS month, {number('value')} AS value, lsoa_code
  FROM {source})"""


CAST = f"{DIRTY}, {cast('dirty')}"
IN_RANGE = """(month IS NULL OR month BETWEEN 1 AND 12)
  AND (year IS NULL OR year BETWEEN 1990 AND 2026) AND (value IS NULL OR value >= 0)"""


def correct(text: str, names: dict[str, str] = fixed.DISTRICT_CORRECTIONS) -> str:
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in names.items())
    return f"CASE {text} {cases} ELSE {text} END"


def normal(source: str) -> str:
    return f"""
normal AS (
  SELECT {correct(title('borough'))} AS borough, {title('major_category')} AS major_category,
         {title('minor_category')} AS minor_category, year, month, value, lsoa_code
  FROM {source})"""


def grouped(source: str) -> str:
    return f"""
totals AS (
  SELECT {KEYS}, coalesce(sum(value), 0.0) AS total_crimes, make_date(year, month, 1) AS date
  FROM {source}
  WHERE borough IS NOT NULL AND major_category IS NOT NULL AND minor_category IS NOT NULL
    AND year IS NOT NULL AND month IS NOT NULL
  GROUP BY {KEYS})"""


CLEAN = f"""{DIRTY}, present AS (SELECT * FROM dirty WHERE {PRESENT}),
{cast('present')}, ranged AS (SELECT * FROM cast_rows WHERE {IN_RANGE}),
{normal('ranged')}"""

TOTALS = f"""{FACTS}, ranged AS (SELECT * FROM facts WHERE {IN_RANGE}), {normal('ranged')},
unique_rows AS (SELECT DISTINCT * FROM normal), {grouped('unique_rows')}"""


def ranking(column: str, limit: str = "") -> str:
    return f"""WITH {TOTALS} SELECT {column}, sum(total_crimes) AS total_crimes
FROM totals GROUP BY {column} ORDER BY total_crimes DESC, {column} {limit}"""


def leader(column: str) -> str:
    return f"""WITH {TOTALS}, g AS (
  SELECT {column}, sum(total_crimes) AS total_crimes FROM totals GROUP BY {column})
SELECT {column}, total_crimes,
       round(total_crimes * 100.0 / (SELECT sum(total_crimes) FROM g), 1) AS share_pct
FROM g ORDER BY total_crimes DESC, {column} LIMIT 1"""


FILTER = f"borough = '{DISTRICT}' AND major_category = '{MAJOR}' AND year = {YEAR}"
EXPORT = """borough AS "Borough", major_category AS "Major Category",
  minor_category AS "Minor Category", year AS "Year", month AS "Month",
  total_crimes AS "Total Crimes", coalesce(CAST(date AS VARCHAR), '') AS "Date" """
MONTH_KEY = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"


def missing(column: str) -> str:
    return f"CAST(count(*) FILTER ({column} IS NULL OR {column} IN ({TOKENS})) AS BIGINT) AS {column}"


def count_if(condition: str) -> str:
    return f"CAST(count(*) FILTER ({condition}) AS BIGINT)"


def report(source: str, rules: list[tuple[str, str, str, str]], ctes: str) -> str:
    """Rules as (name, severity, observed, detail) over one table."""
    rows = "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, '{level}' AS severity, CAST(({seen}) AS BIGINT) AS observed, "
        f"CAST(({detail}) AS VARCHAR) AS detail"
        for name, level, seen, detail in rules
    )
    return f"""WITH {ctes}, counted AS ({rows})
SELECT rule, severity, observed = 0 AS passed, observed, detail FROM counted"""


def surplus(source: str, keys: str) -> str:
    return (
        f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys})"
    )


def tally(source: str, condition: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {condition}"


def quality(source: str, amount: str, processed: bool, ctes: str) -> str:
    level = "hard" if processed else "soft"
    columns = f"{KEYS}, {amount}" + (", date" if processed else ", lsoa_code")
    rules = [
        ("required_columns", level, "0", "''"),
        ("column_types", level, "0", "''"),
    ]
    if processed:
        rules.append(
            (
                "core_nulls",
                "hard",
                "SELECT " + " + ".join(
                    f"count(*) FILTER ({c} IS NULL)"
                    for c in ("borough", "year", "month", amount)
                ) + f" FROM {source}",
                "''",
            )
        )
    if processed:
        rules.append(("year_range", level, tally(source, "year < 1990"), "''"))
    rules += [
        ("month_range", level, tally(source, "month NOT BETWEEN 1 AND 12"), "''"),
        ("no_negatives", level, tally(source, f"{amount} < 0"), "''"),
    ]
    if processed:
        rules.append(("unique_keys", "hard", surplus(source, KEYS), "''"))
    rules += [
        (f"nulls_{c}", "soft", tally(source, f"{c} IS NULL"), "''")
        for c in ("borough", "major_category", amount, "year", "month")
    ]
    span = (
        "SELECT CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) "
        f"ELSE min(year) || '-' || max(year) END FROM {source}"
    )
    rules += [
        ("total_duplicates", "soft", surplus(source, columns), "''"),
        ("total_rows", "info", "0", f"SELECT count(*) FROM {source}"),
        ("year_span", "info", "0", span),
    ]
    return report(source, rules, ctes)


def quantile(column: str, share: float) -> str:
    return f"quantile_cont({column}, {share})"


SCORED = """
scored AS (
  SELECT CAST(l_quantity > 25 AS INTEGER) AS label, l_extendedprice / 105000.0 AS score,
         CAST(l_extendedprice / 105000.0 >= 0.35 AS INTEGER) AS prediction,
         l_quantity AS actual, l_extendedprice / 1500.0 AS predicted
  FROM lineitem)"""
CONFUSION = f"""{SCORED}, confused AS (
  SELECT {count_if('label = 0 AND prediction = 0')} AS true_negatives,
         {count_if('label = 0 AND prediction = 1')} AS false_positives,
         {count_if('label = 1 AND prediction = 0')} AS false_negatives,
         {count_if('label = 1 AND prediction = 1')} AS true_positives
  FROM scored)"""
SCORES = f"""{SCORED}, per_score AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp,
         lead(pos) OVER (ORDER BY score DESC) AS next_pos,
         lead(neg) OVER (ORDER BY score DESC) AS next_neg,
         row_number() OVER (ORDER BY score DESC) AS place
  FROM per_score WINDOW up AS (ORDER BY score DESC)),
whole AS (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM per_score)"""

RUNS = """
stages AS (
  SELECT CAST(ts AS DATE) AS day, event_type AS stage, round(sum(value), 2) AS duration_s,
         count(*) AS came, count(*) FILTER (value > 20) AS records_out,
         count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) > 90) AS warned
  FROM events GROUP BY ALL),
runs AS (
  SELECT day, CAST(day AS VARCHAR) AS run_id,
         CAST(day AS VARCHAR) || 'T06:00:00+00:00' AS timestamp,
         day(day) % 7 = 0 AS demo_mode, round(sum(duration_s), 2) AS total_duration_seconds,
         CAST(sum(came) AS BIGINT) AS records_initial,
         CAST(sum(records_out) AS BIGINT) AS records_final,
         round((1.0::DOUBLE - sum(records_out)::DOUBLE / sum(came)) * 100, 1) AS reduction_pct,
         round(100.0::DOUBLE * sum(records_out) / sum(came), 1) AS completeness_pct,
         CAST(sum(warned) AS BIGINT) AS warnings_count
  FROM stages GROUP BY day),
staged AS (
  SELECT day, stage, duration_s, CASE WHEN stage <> 'signup' THEN came END AS records_in,
         records_out,
         CASE WHEN stage <> 'signup' AND came > 0
              THEN round_even((1.0::DOUBLE - records_out::DOUBLE / came) * 100, 1) END AS reduction_pct
  FROM stages)"""
HOURLY = (
    RUNS.replace("CAST(ts AS DATE) AS day", "date_trunc('hour', ts) AS day")
    .replace("CAST(day AS VARCHAR) AS run_id", "strftime(day, '%Y-%m-%d') AS run_id")
    .replace(
        "CAST(day AS VARCHAR) || 'T06:00:00+00:00'", "strftime(day, '%Y-%m-%dT%H:00:00+00:00')"
    )
)
MODE = f"CASE WHEN demo_mode THEN '{fixed.MODE_DEMO}' ELSE '{fixed.MODE_PRODUCTION}' END"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"


def draw(place: int) -> str:
    return f"CAST('0x' || substr(digest, {1 + 8 * place}, 8) AS BIGINT)"


def sample_sql() -> str:
    # cumulative Poisson probabilities, as whole parts of 2 ** 32: a draw above k of them is k
    steps = (
        "(SELECT list(CAST(floor(c * 4294967296) AS BIGINT) ORDER BY k) FROM ("
        f"SELECT k, sum(exp(-{fixed.SAMPLE_MEAN}::DOUBLE + k * ln({fixed.SAMPLE_MEAN}) - lgamma(k + 1)))"
        " OVER (ORDER BY k) AS c FROM range(100) r(k)))"
    )
    years = ", ".join(str(y) for y in fixed.SAMPLE_YEARS)
    span = fixed.SAMPLE_AREA_STOP - fixed.SAMPLE_AREA_START
    return f"""
WITH pairs AS (SELECT p_type AS major, list_sort(list(DISTINCT p_brand)) AS minors
               FROM part GROUP BY p_type),
pool AS (SELECT list(p ORDER BY p.major) AS pool FROM pairs p),
names AS (SELECT list_sort(list(DISTINCT n_name)) AS names FROM nation),
stepped AS (SELECT {steps} AS steps),
hashed AS (SELECT o_orderkey AS id,
                  sha256('{fixed.SAMPLE_SEED}:' || CAST(o_orderkey AS VARCHAR)) AS digest
           FROM orders),
drawn AS (SELECT *, pool[1 + {draw(1)} % len(pool)] AS category FROM hashed, pool, names, stepped),
made AS (
  SELECT id,
    'E010' || lpad(CAST({fixed.SAMPLE_AREA_START} + {draw(3)} % {span} AS VARCHAR), 5, '0') AS lsoa_code,
    names[1 + {draw(0)} % len(names)] AS borough, category.major AS major_category,
    category.minors[1 + {draw(2)} % len(category.minors)] AS minor_category,
    CAST(len(list_filter(steps, lambda s: s < {draw(4)})) AS BIGINT) AS value,
    CAST([{years}][1 + {draw(5)} % {len(fixed.SAMPLE_YEARS)}] AS BIGINT) AS year,
    CAST(1 + {draw(6)} % 12 AS BIGINT) AS month
  FROM drawn)
SELECT id, lsoa_code, CASE WHEN id % 1000 = 0 THEN NULL ELSE borough END AS borough, major_category,
       CASE WHEN id % 1000 = 3 THEN 'Unknown' ELSE minor_category END AS minor_category,
       CASE WHEN id % 1000 = 2 THEN CAST(-5 AS BIGINT) ELSE value END AS value, year,
       CASE WHEN id % 1000 = 1 THEN CAST(13 AS BIGINT) ELSE month END AS month
FROM made"""


STEP_SQL = f"""
WITH {DIRTY}, marked AS (SELECT *, NOT coalesce({PRESENT}, false) AS gone FROM dirty),
typed AS (
  SELECT borough, major_category, minor_category, {whole('year')} AS year,
         {whole('month')} AS month, {number('value')} AS value, lsoa_code,
         gone FROM marked),
labelled AS (
  SELECT *, CASE WHEN gone THEN 'missing' WHEN month NOT BETWEEN 1 AND 12 THEN 'month'
                 WHEN year NOT BETWEEN 1990 AND 2026 THEN 'year'
                 WHEN value < 0 THEN 'measure' ELSE 'kept' END AS step FROM typed),
kept AS (SELECT * FROM labelled WHERE step = 'kept'), {normal('kept')},
unique_rows AS (SELECT DISTINCT * FROM normal), {grouped('unique_rows')},
counts AS (
  SELECT (SELECT count(*) FROM labelled) AS all_rows,
         (SELECT count(*) FROM labelled WHERE step = 'missing') AS missing,
         (SELECT count(*) FROM labelled WHERE step = 'month') AS bad_month,
         (SELECT count(*) FROM labelled WHERE step = 'year') AS bad_year,
         (SELECT count(*) FROM labelled WHERE step = 'measure') AS bad_measure,
         (SELECT count(*) FROM normal) - (SELECT count(*) FROM unique_rows) AS copies,
         (SELECT count(*) FROM unique_rows WHERE minor_category IS NULL OR year IS NULL
            OR month IS NULL) AS null_key,
         (SELECT count(*) FROM totals) AS groups),
steps AS (
  SELECT 1 AS position, 'missing' AS step, missing AS gone FROM counts
  UNION ALL SELECT 2, 'month', bad_month FROM counts
  UNION ALL SELECT 3, 'year', bad_year FROM counts
  UNION ALL SELECT 4, 'measure', bad_measure FROM counts
  UNION ALL SELECT 5, 'copies', copies FROM counts
  UNION ALL SELECT 6, 'null_key', null_key FROM counts
  UNION ALL SELECT 7, 'merged',
    all_rows - missing - bad_month - bad_year - bad_measure - copies - null_key - groups
    FROM counts)
SELECT position, step,
       CAST(all_rows - sum(gone) OVER (ORDER BY position) + gone AS BIGINT) AS rows_in,
       CAST(all_rows - sum(gone) OVER (ORDER BY position) AS BIGINT) AS rows_out,
       gone AS rows_removed
FROM steps, counts"""

FENCES = f"""{TOTALS}, fences AS (
  SELECT {quantile('total_crimes', 0.25)} AS q1, {quantile('total_crimes', 0.75)} AS q3
  FROM totals)"""
IQR_OUT = "total_crimes < q1 - 1.5 * (q3 - q1) OR total_crimes > q3 + 1.5 * (q3 - q1)"
SPREAD = f"""{TOTALS}, spread AS (
  SELECT avg(total_crimes) AS mean, stddev_samp(total_crimes) AS std FROM totals)"""
Z_OUT = "abs((total_crimes - mean) / std) > 3"
DASHED = ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '-') AS {c}"
    for c in [*KEYS.split(", "), "value", "lsoa_code"]
)


def summary(method: str, ctes: str, outside: str, source: str) -> str:
    return f"""WITH {ctes}
SELECT '{method}' AS method, count(*) AS n_rows, {count_if(outside)} AS n_outliers,
       min(total_crimes) FILTER ({outside}) AS outlier_min,
       max(total_crimes) FILTER ({outside}) AS outlier_max,
       round({quantile('total_crimes', 0.05)}, 6) AS q05,
       round({quantile('total_crimes', 0.95)}, 6) AS q95
FROM totals, {source}"""


def infinite(ranges: str) -> str:
    """Quantiles by rank: between two equal values, infinite too, there is nothing to add."""

    def at(share: float) -> str:
        low = f"max(x) FILTER (place = floor({share}::DOUBLE * (n - 1)))"
        high = f"max(x) FILTER (place = ceil({share}::DOUBLE * (n - 1)))"
        part = f"({share}::DOUBLE * max(n - 1) - floor({share}::DOUBLE * max(n - 1)))"
        name = f"q{share * 100:g}".replace(".", "_")
        name = "q" + name[1:].zfill(2)
        return f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * {part} END AS {name}"

    return f"""SELECT max(n) AS n, {', '.join(at(s) for s in INFINITE_SHARES)}, '{ranges}' AS ranges
FROM ranked"""


def kpi_sql(ctes: str) -> str:
    return f"""WITH {ctes}, newest AS (SELECT * FROM runs ORDER BY timestamp DESC LIMIT 1),
slow AS (SELECT stage, duration_s FROM staged JOIN newest USING (day)
         ORDER BY duration_s DESC, stage LIMIT 1),
levels AS (SELECT count(*) FILTER (event_type = 'error') AS errors,
                  count(*) FILTER (event_type = 'signup') AS warnings FROM events)
SELECT run_id, round_even(total_duration_seconds, 1) AS duration_seconds, errors, warnings,
       CASE WHEN errors = 0 THEN '{fixed.STABLE}' ELSE '{fixed.UNSTABLE}' END AS stability,
       stage AS slowest_stage, duration_s AS slowest_seconds, completeness_pct, warnings_count
FROM newest, slow, levels"""


STAT_ROWS = f"""
SELECT '{fixed.STAT_RAW}' AS stage, '~' || format('{{:,}}', came) AS records,
       '-' AS records_out FROM newest
UNION ALL SELECT '{fixed.STAGE_CLEAN}', '-', '-'
UNION ALL SELECT '{fixed.STAT_AGGREGATED}', '-', format('{{:,}}', gone) FROM newest
UNION ALL SELECT '{fixed.STAT_TOTAL}', '-', '-'"""
NEWEST = """newest AS (SELECT records_initial AS came, records_final AS gone
  FROM runs ORDER BY timestamp DESC LIMIT 1)"""
UNIQUE_ROWS = "unique_rows AS (SELECT DISTINCT * FROM normal)"


def short_report() -> str:
    """The processed rules on totals without a date and a total, the month being text."""
    rules = [
        ("required_columns", "hard", "2", "'total_crimes, date'"),
        ("column_types", "hard", "1", "''"),
        (
            "core_nulls",
            "hard",
            "SELECT " + " + ".join(
                f"count(*) FILTER ({c} IS NULL)" for c in ("borough", "year", "month")
            ) + " FROM totals",
            "''",
        ),
        ("year_range", "hard", tally("totals", "year < 1990"), "''"),
        ("month_range", "hard", tally("totals", "month NOT BETWEEN 1 AND 12"), "''"),
        ("unique_keys", "hard", surplus("totals", KEYS), "''"),
        *[
            (f"nulls_{c}", "soft", tally("totals", f"{c} IS NULL"), "''")
            for c in ("borough", "major_category", "year", "month")
        ],
        ("total_duplicates", "soft", surplus("totals", KEYS), "''"),
        ("total_rows", "info", "0", "SELECT count(*) FROM totals"),
        ("year_span", "info", "0", "SELECT min(year) || '-' || max(year) FROM totals"),
    ]
    return report("totals", rules, TOTALS)


def split(early: str) -> str:
    return f"""WITH {TOTALS}
SELECT 'train' AS side, count(*) AS n_rows FROM totals WHERE {early}
UNION ALL SELECT 'test', count(*) FROM totals WHERE NOT ({early})"""


HASH_SIDE = (
    f"CAST('0x' || substr(md5(concat_ws('|', '{fixed.RANDOM_SEED}', {KEYS})), 1, 8) AS BIGINT)"
    " % 1000 >= 300"
)


def above(threshold: str, ctes: str = TOTALS) -> str:
    return f"""WITH {ctes}, t AS ({threshold})
SELECT totals.*, CAST(total_crimes > threshold AS INTEGER) AS label FROM totals, t"""


def summary_sql() -> str:
    return f"""WITH {RUNS}, listed AS (
  SELECT day, list(concat_ws(' ',
    printf('%5.1f%%', coalesce(100 * duration_s / nullif(total_duration_seconds, 0), 0)), stage,
    printf('(%.2f s,', duration_s),
    coalesce(records_in::VARCHAR, '?') || ' rows to ' || coalesce(records_out::VARCHAR, '?') || ')')
    ORDER BY duration_s DESC, stage) AS lines
  FROM staged JOIN runs USING (day) GROUP BY day),
whole AS (
  SELECT timestamp, list_concat(
    [timestamp || ' in mode ' || {MODE},
     printf('%d of %d rows kept in %.2f s', records_final, records_initial, total_duration_seconds),
     printf('%.1f%% complete, 0 outliers, %d warnings', completeness_pct, warnings_count)],
    lines) AS lines
  FROM runs JOIN listed USING (day))
SELECT timestamp, CAST(unnest(range(len(lines))) AS INTEGER) AS position, unnest(lines) AS line
FROM whole"""


def validation_sql() -> str:
    inner = quality("totals", "total_crimes", True, TOTALS)
    return f"""SELECT CASE WHEN severity = 'info' THEN 'info ' || rule || ' is ' || detail
  WHEN passed THEN 'ok ' || rule
  ELSE 'found ' || observed || ' in ' || rule
    || CASE WHEN detail <> '' THEN ' (' || detail || ')' ELSE '' END END AS line
FROM ({inner}) UNION ALL SELECT '# rules checked at 2024-01-31 06:00:00' AS line"""


def dashboard_sql() -> str:
    shown = f"(SELECT * FROM totals WHERE {FILTER})"

    def groups(columns: str, source: str = shown) -> str:
        return f"SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {source})"

    top = f"least(10, ({groups('minor_category')}))"
    counted = {
        "districts": groups("borough", "totals"),
        "majors": groups("major_category", "totals"),
        "years": groups("year", "totals"),
        "minors": groups("minor_category", f"(SELECT * FROM totals WHERE major_category = '{MAJOR}')"),
        "counts": "1",
        "total": "1",
        "by_district": groups("borough"),
        "by_major": groups("major_category"),
        "top_minors": f"SELECT {top}",
        "leading_district": f"SELECT least(1, count(*)) FROM {shown}",
        "leading_major": f"SELECT least(1, count(*)) FROM {shown}",
        "trend": groups("year, month"),
        "year_span": "1",
        "district_by_year": groups("borough"),
        "export_filtered": f"SELECT count(*) FROM {shown}",
        "export_aggregated": f"SELECT ({groups('borough')}) + {top} + ({groups('year, month')})",
        "export_complete": "SELECT count(*) FROM totals",
    }
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST(({sql}) AS BIGINT) AS n_rows" for name, sql in counted.items()
    )
    return f"WITH {TOTALS} {rows}"


def oracles() -> dict[str, str]:
    years = ", ".join(
        f'coalesce(sum(total_crimes) FILTER (year = {y}), 0.0) AS "{y}"' for y in YEARS
    )
    after = (
        "(borough, major_category, minor_category, year, month) > "
        "('Nation_20', 'Medium', 'Brand#11', 1998, 6)"
    )
    tag_d, tag_m, tag_t = TAGS
    turn = "2 * pi() * month / 12.0::DOUBLE"
    split_until = f"year <= {TRAIN_UNTIL}"
    out = {
        "standard_names": f"WITH {DIRTY} SELECT * FROM dirty",
        "clean_null_tokens": f"WITH {DIRTY} SELECT * FROM dirty WHERE {PRESENT}",
        "clean_cast": f"WITH {CAST} SELECT * FROM cast_rows",
        "clean_ranges": f"WITH {CAST} SELECT * FROM cast_rows WHERE {IN_RANGE}",
        "clean_ranges_drop_null": (
            f"WITH {CAST} SELECT * FROM cast_rows WHERE {IN_RANGE} AND value IS NOT NULL"
        ),
        "clean_text": f"WITH {DIRTY}, {normal('dirty')} SELECT * FROM normal",
        "correct_spellings": f"""WITH {DIRTY}, pairs AS (
  SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(r_name, borough) AS borough, count(*) AS n_rows
FROM dirty LEFT JOIN pairs ON borough = n_name GROUP BY 1""",
        "corrected_names": f"""WITH {DIRTY}, named AS (
  SELECT {correct(title('borough'), NEW_NAMES)} AS borough FROM dirty)
SELECT borough, count(*) AS n_rows FROM named GROUP BY borough""",
        "dedup_exact": f"WITH {FACTS} SELECT DISTINCT * FROM facts",
        "agg_facts": f"""WITH {FACTS}
SELECT {KEYS}, sum(value) AS total_crimes FROM facts GROUP BY {KEYS}""",
        "clean_full": f"""WITH {CLEAN}, unique_rows AS (SELECT DISTINCT * FROM normal),
{grouped('unique_rows')} SELECT * FROM totals""",
        "clean_full_keep_copies": f"WITH {CLEAN}, {grouped('normal')} SELECT * FROM totals",
        "date_from_parts": f"""WITH {CAST}
SELECT year, month, try_cast(year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' AS DATE)
  AS date FROM cast_rows""",
        "keep_columns": f"WITH {FACTS} SELECT {KEYS}, value AS total_crimes FROM facts",
        "rows_removed": STEP_SQL,
        "sum_by_district": ranking("borough"),
        "sum_by_major": ranking("major_category"),
        "sum_by_minor": ranking("minor_category"),
        "trend_monthly": f"""WITH {TOTALS}
SELECT {MONTH_KEY} AS month_key, sum(total_crimes) AS total_crimes
FROM totals GROUP BY year, month ORDER BY 1""",
        "matrix_district_year": f"""WITH {TOTALS}
SELECT borough, {years} FROM totals GROUP BY borough""",
        "matrix_district_year_map": f"""WITH {TOTALS}
SELECT borough, year, sum(total_crimes) AS total_crimes FROM totals GROUP BY borough, year""",
        "grand_total": f"WITH {TOTALS} SELECT sum(total_crimes) AS total_crimes FROM totals",
        "distinct_values": f"""WITH {TOTALS}
SELECT DISTINCT 'borough' AS kind, borough AS item FROM totals
UNION ALL SELECT DISTINCT 'major_category', major_category FROM totals
UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM totals""",
        "distinct_counts": f"""WITH {TOTALS}
SELECT count(DISTINCT borough) AS n_borough, count(DISTINCT major_category) AS n_major_category
FROM totals""",
        "year_span": f"""WITH {TOTALS}
SELECT min(year) AS year_min, max(year) AS year_max,
       CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR)
            ELSE min(year) || '-' || max(year) END AS label FROM totals""",
        "leader_district": leader("borough"),
        "leader_major": leader("major_category"),
        "filtered_rows": f"WITH {TOTALS} SELECT * FROM totals WHERE {FILTER}",
        "filtered_total": f"""WITH {TOTALS}
SELECT coalesce(sum(total_crimes), 0.0) AS total_crimes FROM totals WHERE {FILTER}""",
        "minor_given_major": f"""WITH {TOTALS}
SELECT DISTINCT minor_category FROM totals WHERE major_category = '{MAJOR}' ORDER BY 1""",
        "top10_minor": ranking("minor_category", "LIMIT 10"),
        "page_slice": f"WITH {TOTALS} SELECT * FROM totals ORDER BY {KEYS} LIMIT 100 OFFSET 300",
        "page_after": f"""WITH {TOTALS}
SELECT * FROM totals WHERE {after} ORDER BY {KEYS} LIMIT 25""",
        "display_rows": f"""WITH {CAST} SELECT {DASHED} FROM cast_rows""",
        "grouped_numbers": f"""WITH {TOTALS}
SELECT year, format('{{:,}}', CAST(sum(total_crimes) AS BIGINT)) AS shown
FROM totals GROUP BY year""",
        "row_cap_ordered": "SELECT * FROM lineitem ORDER BY ALL LIMIT 5000",
        "row_cap": "SELECT * FROM lineitem LIMIT 4321",
        "export_filtered": f"WITH {TOTALS} SELECT {EXPORT} FROM totals WHERE {FILTER}",
        "export_complete": f"WITH {TOTALS} SELECT {EXPORT} FROM totals",
        "export_aggregated": f"""WITH {TOTALS}, top AS (
  SELECT minor_category, sum(total_crimes) AS total FROM totals GROUP BY 1
  ORDER BY total DESC, minor_category LIMIT 10)
SELECT '{tag_d}' AS "Type", borough AS "Borough", '' AS "Minor Category", '' AS "Date",
       sum(total_crimes) AS "Total Crimes" FROM totals GROUP BY borough
UNION ALL SELECT '{tag_m}', '', minor_category, '', total FROM top
UNION ALL SELECT '{tag_t}', '', '', {MONTH_KEY}, sum(total_crimes) FROM totals GROUP BY year, month""",
        "null_counts": f"""WITH {DIRTY} SELECT
{', '.join(missing(c) for c in [*KEYS.split(', '), 'value', 'lsoa_code'])} FROM dirty""",
        "critical_nulls": f"""WITH {DIRTY} SELECT
{', '.join(f"{count_if(c + ' IS NULL')} AS nulls_{c}" for c in
           ('borough', 'major_category', 'value', 'year', 'month'))} FROM dirty""",
        "completeness": f"""WITH {CAST}
SELECT round(100.0::DOUBLE * (4 * count(*) - count(*) FILTER (borough IS NULL)
  - count(*) FILTER (year IS NULL) - count(*) FILTER (month IS NULL)
  - count(*) FILTER (value IS NULL)) / (4 * count(*)), 6) AS completeness_pct FROM cast_rows""",
        "dup_surplus": f"""WITH {FACTS}
SELECT CAST(({surplus('facts', KEYS + ', value, lsoa_code')}) AS BIGINT) AS surplus""",
        "key_dup_surplus": f"""WITH {FACTS}
SELECT CAST(({surplus('facts', KEYS)}) AS BIGINT) AS surplus""",
        "range_violations": f"""WITH {CAST}
SELECT {count_if('month NOT BETWEEN 1 AND 12')} AS bad_months,
       {count_if('year NOT BETWEEN 1990 AND 2026')} AS bad_years,
       {count_if('value < 0')} AS negatives, {count_if('value IS NULL')} AS null_measures,
       (SELECT {count_if(f"({number('month')}) <> floor({number('month')})"
                         f" OR ({number('year')}) <> floor({number('year')})")} FROM dirty)
         AS fractional, min(year) AS year_min, max(year) AS year_max FROM cast_rows""",
        "quality_report": quality("totals", "total_crimes", True, TOTALS),
        "quality_report_faulty": quality(
            "faulty",
            "total_crimes",
            True,
            f"""{CAST}, faulty AS (SELECT {KEYS}, value AS total_crimes,
  try_cast(year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' AS DATE) AS date
  FROM cast_rows)""",
        ),
        "quality_report_raw": quality("cast_rows", "value", False, CAST),
        "validation_lines": validation_sql(),
        "quality_report_short": short_report(),
        "outliers_without_totals": f"""SELECT 'iqr' AS method, CAST(0 AS BIGINT) AS n_rows,
  CAST(0 AS BIGINT) AS n_outliers, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in
  ('outlier_min', 'outlier_max', 'q05', 'q95'))}, CAST(0 AS BIGINT) AS n_flagged""",
        "quantiles": f"""WITH {TOTALS} SELECT count(*) AS n,
{', '.join(f"round({quantile('total_crimes', s)}, 6) AS q{n}" for s, n in
           ((0.05, '05'), (0.95, '95'), (0.25, '25'), (0.75, '75'), (0.5, '50')))} FROM totals""",
        "price_quantiles": f"""SELECT count(*) AS n,
{', '.join(f"round({quantile('l_extendedprice', s)}, 6) AS q{n}" for s, n in
           ((0.05, '05'), (0.5, '50'), (0.95, '95')))} FROM lineitem""",
        "quantiles_infinite": f"""WITH valued AS (
  SELECT CASE l_orderkey % 10 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE
              ELSE l_extendedprice END AS x FROM lineitem),
ranked AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS n FROM valued)
{infinite('one')} UNION ALL {infinite('many')}""",
        "mean_and_spread": f"""WITH {SPREAD}
SELECT round(mean, 6) AS mean, round(std, 6) AS std FROM spread""",
        "outliers_iqr": f"WITH {FENCES} SELECT totals.* FROM totals, fences WHERE {IQR_OUT}",
        "outliers_zscore": f"WITH {SPREAD} SELECT totals.* FROM totals, spread WHERE {Z_OUT}",
        "outlier_summary": summary("iqr", FENCES, IQR_OUT, "fences"),
        "outlier_summary_zscore": summary("zscore", SPREAD, Z_OUT, "spread"),
        "target_median": above("SELECT median(total_crimes) AS threshold FROM totals"),
        "target_mean": above("SELECT avg(total_crimes) AS threshold FROM totals"),
        "target_from_train": above(
            f"SELECT median(total_crimes) AS threshold FROM totals WHERE {split_until}"
        ),
        "feature_columns": f"""WITH {TOTALS}
SELECT borough, major_category, minor_category, year, round(sin({turn}), 6) AS month_sin,
       round(cos({turn}), 6) AS month_cos FROM totals""",
        "cyclical_month": f"""WITH {TOTALS}
SELECT year, month, round(sin({turn}), 6) AS month_sin, round(cos({turn}), 6) AS month_cos
FROM totals""",
        "standard_scale": f"""WITH {TOTALS}, turned AS (SELECT *, sin({turn}) AS s FROM totals),
stats AS (SELECT avg(year) AS my, stddev_pop(year) AS sy, avg(s) AS ms, stddev_pop(s) AS ss FROM turned)
SELECT {KEYS}, round((year - my) / sy, 5) AS year_scaled, round((s - ms) / ss, 5) AS month_sin_scaled
FROM turned, stats""",
        "temporal_split_counts": split(split_until),
        "fallback_split_counts": split(HASH_SIDE),
        "onehot_width": f"""WITH {TOTALS}, train AS (SELECT * FROM totals WHERE {split_until})
SELECT (SELECT count(DISTINCT borough) + count(DISTINCT major_category)
          + count(DISTINCT minor_category) + 3 FROM train) AS width, count(*) AS n_rows,
  CAST(count(*) FILTER (borough IN (SELECT borough FROM train))
    + count(*) FILTER (major_category IN (SELECT major_category FROM train))
    + count(*) FILTER (minor_category IN (SELECT minor_category FROM train)) AS BIGINT) AS n_filled
FROM totals WHERE NOT ({split_until})""",
        "onehot_slots": f"""WITH {TOTALS},
rows AS (WITH {CLEAN}, {UNIQUE_ROWS}, {grouped('unique_rows')} SELECT * FROM totals)
SELECT {KEYS}, {', '.join(
    f"CAST({c} IN (SELECT {c} FROM totals) AS INTEGER) AS slots_{c}"
    for c in ('borough', 'major_category', 'minor_category'))} FROM rows""",
        "classifier_optimum": f"""WITH {TOTALS}
SELECT CAST(unnest(range(count(DISTINCT borough) + count(DISTINCT major_category)
  + count(DISTINCT minor_category) + 3)) AS INTEGER) AS feature, 0.0::DOUBLE AS gradient
FROM totals""",
        "train_eval": f"""WITH {TOTALS}, sides AS (
  SELECT {count_if(split_until)} AS train_rows, {count_if(f'NOT ({split_until})')} AS test_rows
  FROM totals)
SELECT train_rows, test_rows, test_rows AS scored_rows, test_rows AS confused_rows,
  true AS accuracy_holds, true AS precision_holds, true AS recall_holds, true AS mae_holds,
  true AS r2_holds, true AS forest_in_range FROM sides""",
        "score_batch": f"""WITH {TOTALS}, {FACTS.replace('facts AS', 'given AS')}
SELECT DISTINCT {KEYS}, true AS sums_to_one, true AS class_fits, true AS estimate_fits,
  CAST((SELECT count(DISTINCT borough) + count(DISTINCT major_category)
    + count(DISTINCT minor_category) + 3 FROM totals WHERE {split_until}) AS INTEGER)
    AS features_used
FROM given""",
        "metrics_document": f"""WITH {TOTALS}
SELECT 'LogisticRegression' AS model, {count_if(split_until)} AS train_rows,
  {count_if(f'NOT ({split_until})')} AS test_rows, '{fixed.LOG_SCHEMA_VERSION}' AS schema_version,
  CAST({fixed.FOREST_TREES} AS BIGINT) AS forest_trees, CAST({TRAIN_UNTIL} AS BIGINT) AS train_until
FROM totals""",
        "confusion": f"WITH {CONFUSION} SELECT * FROM confused",
        "class_metrics": f"""WITH {CONFUSION}, d AS (
  SELECT true_negatives::DOUBLE AS tn, false_positives::DOUBLE AS fp,
         false_negatives::DOUBLE AS fn, true_positives::DOUBLE AS tp FROM confused)
SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision,
       round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1_score
FROM d""",
        "reg_metrics": f"""WITH {SCORED}
SELECT round(avg(abs(actual - predicted)), 4) AS mae,
       round(1 - avg((actual - predicted) ** 2) / var_pop(actual), 4) AS r2 FROM scored""",
        "auc_gini": f"""WITH {SCORES}, area AS (
  SELECT sum(neg * (tp - pos + pos / 2.0)) / max(p) / max(n) AS a FROM curve, whole)
SELECT round(a, 4) AS roc_auc, round(2 * a - 1, 4) AS gini FROM area""",
        "roc_points": f"""WITH {SCORES}
SELECT round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM curve, whole
WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE""",
        "sample_facts": sample_sql(),
        "etl_run": f"""WITH {CLEAN}, unique_rows AS (SELECT DISTINCT * FROM normal),
{grouped('unique_rows')} SELECT * FROM totals""",
        "etl_record": f"""WITH {CLEAN}, {UNIQUE_ROWS}, {grouped('unique_rows')},
fences AS (SELECT {quantile('total_crimes', 0.25)} AS q1, {quantile('total_crimes', 0.75)} AS q3
           FROM totals)
SELECT '{fixed.LOG_SCHEMA_VERSION}' AS schema_version, false AS demo_mode,
  (SELECT count(*) FROM dirty) AS records_initial, (SELECT count(*) FROM totals) AS records_final,
  100.0::DOUBLE AS completeness_pct,
  (SELECT count(*) FROM totals, fences WHERE {IQR_OUT}) AS outliers_detected,
  CAST(0 AS BIGINT) AS warnings_count,
  '{fixed.STAGE_INGEST},{fixed.STAGE_CLEAN},{fixed.STAGE_VALIDATE},{fixed.STAGE_SAVE},{fixed.STAGE_LOAD}'
    AS stages""",
        "validated_round_trip": f"WITH {TOTALS} SELECT * FROM totals",
        "validated_report": validation_sql(),
        "json_dimensions": """
SELECT DISTINCT n_name AS major, '' AS minor FROM nation
UNION ALL SELECT DISTINCT p_type, p_brand FROM part""",
        "csv_round_trip": f"WITH {TOTALS} SELECT * FROM totals",
        "export_round_trip": f"""WITH {TOTALS}
SELECT borough AS "Borough", major_category AS "Major Category",
       minor_category AS "Minor Category", CAST(year AS VARCHAR) AS "Year",
       CAST(month AS VARCHAR) AS "Month",
       CAST(CAST(total_crimes AS BIGINT) AS VARCHAR) AS "Total Crimes",
       CAST(date AS VARCHAR) AS "Date" FROM totals""",
        "run_log_round_trip": f"""WITH {RUNS}
SELECT timestamp, demo_mode, records_initial, records_final, stage,
       duration_s AS duration_seconds, records_in, staged.records_out
FROM runs JOIN staged USING (day)""",
        "streamed_rows": f"WITH {CLEAN} SELECT * FROM normal",
        "streamed_unique_rows": f"WITH {CLEAN} SELECT DISTINCT * FROM normal",
        "streamed_totals": f"""WITH {CLEAN}, {UNIQUE_ROWS}, {grouped('unique_rows')}
SELECT * FROM totals""",
        "refreshed_totals": f"""WITH {CLEAN}, {UNIQUE_ROWS}, {grouped('unique_rows')}
SELECT * FROM totals""",
        "run_latest": f"""WITH {RUNS}
SELECT '1.0' AS schema_version, timestamp, demo_mode, total_duration_seconds, records_initial,
       records_final, reduction_pct, completeness_pct, CAST(0 AS BIGINT) AS outliers_detected,
       warnings_count FROM runs ORDER BY timestamp DESC LIMIT 1""",
        "run_entries": f"""WITH {RUNS}
SELECT run_id, {MODE} AS mode, round_even(total_duration_seconds, 1) AS duration_seconds,
       records_initial AS total_records_in, records_final AS total_records_out,
       completeness_pct, warnings_count, stage, duration_s, records_in,
       staged.records_out, staged.reduction_pct
FROM runs JOIN staged USING (day)""",
        "run_history5": f"""WITH {RUNS}
SELECT run_id, {MODE} AS mode, round_even(total_duration_seconds, 1) AS duration_seconds,
       records_initial AS total_records_in, records_final AS total_records_out
FROM runs ORDER BY timestamp DESC LIMIT 5""",
        "run_history_prepend": f"""WITH {HOURLY}
SELECT run_id, timestamp, round_even(total_duration_seconds, 1) AS duration_seconds FROM runs
ORDER BY timestamp = (SELECT min(timestamp) FROM runs) DESC, timestamp DESC LIMIT 5""",
        "run_stage_shares": f"""WITH {RUNS}
SELECT CAST(day AS VARCHAR) AS run_id, stage, duration_s,
       round(duration_s * 100.0 / sum(duration_s) OVER (PARTITION BY day), 1) AS share_pct
FROM staged""",
        "run_kpis": kpi_sql(RUNS),
        "run_kpis_hourly": kpi_sql(HOURLY),
        "log_errors": f"""
SELECT event_id, strftime(ts, '%H:%M:%S') AS ts, {LEVEL} AS level,
       event_type || ' by ' || user_id AS msg FROM events WHERE event_type = 'error'""",
        "log_levels": """
SELECT count(*) FILTER (event_type = 'error') AS errors,
       count(*) FILTER (event_type = 'signup') AS warnings FROM events""",
        "sample_rollup": """
SELECT event_type, round(coalesce(avg(value - 10) FILTER (value - 10 > 0), 0.0), 6) AS mean_positive,
       round(max(value - 10), 6) AS peak FROM events GROUP BY event_type""",
        "run_stats": f"WITH {RUNS}, {NEWEST} {STAT_ROWS}",
        "run_stat_of": f"""WITH {RUNS}, {NEWEST}, stats AS ({STAT_ROWS})
SELECT * FROM stats WHERE stage = '{fixed.STAT_RAW}'""",
        "published_stats": f"""WITH {CLEAN}, {UNIQUE_ROWS}, {grouped('unique_rows')},
newest AS (SELECT (SELECT count(*) FROM dirty) AS came, (SELECT count(*) FROM totals) AS gone)
{STAT_ROWS}""",
        "run_summary": summary_sql(),
        "dashboard_tables": dashboard_sql(),
        "run_json": f"""WITH {RUNS}
SELECT timestamp, demo_mode, records_initial, warnings_count,
       (SELECT count(*) FROM stages s WHERE s.day = runs.day) AS n_stages FROM runs""",
        "scalar_functions": f"""WITH {CAST}
SELECT coalesce(borough, '') AS blank_borough, {title('major_category')} AS titled,
       {MONTH_KEY} AS month_key, '2024-02-03' AS day,
       greatest(0.0::DOUBLE, coalesce(value, 0.0)) AS clamped,
       round_even(value / 4, 0) AS half_even,
       CAST(CAST(value AS BIGINT) AS VARCHAR) AS plain,
       CASE WHEN month <> 0 THEN round(value * 100.0 / month, 1) END AS pct
FROM cast_rows""",
    }
    return out
