"""DuckDB statements that state each query's result independently.

They follow the definitions (nested loops over windows and intervals, Fourier
sums) rather than the plans of this package.
"""

from __future__ import annotations

import math

DURATION = 2592000.0
DOC_KEYS = "d.doc_id = l.doc_id"

# Unmatched windows must not read their null bounds as open ones, hence the
# explicit check of the join.
EVENTS_CTE = """
ev AS (
  SELECT user_id, event_type, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS onset
  FROM events),
iv AS (
  SELECT user_id, onset,
         least(onset + value * 60, lead(onset) OVER (PARTITION BY user_id ORDER BY onset)) AS fin
  FROM ev WHERE event_type = 'error'),
rec AS (
  SELECT DISTINCT user_id, 'sub-' || user_id AS subject,
         '/rec/sub-' || user_id || '/ses-01/eeg/sub-' || user_id
         || '_ses-01_task-monitor_run-00_eeg.edf' AS path
  FROM events)"""


def _grid(size: float, stride: float) -> str:
    n = math.floor((DURATION - size) / stride) + 1
    return f"""
win AS (
  SELECT rec.*, k * {stride}::DOUBLE AS ws, k * {stride}::DOUBLE + {size}::DOUBLE AS we
  FROM rec, range(0, {n}) t(k))"""


def _ratio_ctes(size: float, stride: float) -> str:
    return f"""{EVENTS_CTE},{_grid(size, stride)},
cov AS (
  SELECT w.user_id, w.subject, w.path, w.ws, w.we,
         sum(CASE WHEN i.user_id IS NULL THEN 0.0
             ELSE greatest(0.0, least(we, fin) - greatest(ws, onset)) END) AS overlap_sec
  FROM win w LEFT JOIN iv i
    ON w.user_id = i.user_id AND i.onset < w.we AND coalesce(i.fin > w.ws, true)
  GROUP BY ALL),
rat AS (
  SELECT *, least(overlap_sec, we - ws) / (we - ws) AS ratio FROM cov)"""


def _windows(size: float, stride: float) -> str:
    return f"""WITH {EVENTS_CTE},{_grid(size, stride)}
SELECT path, ws AS start_sec, we AS end_sec, round(we - ws, 6) AS duration_sec FROM win"""


def _drifting(size: float, stride: float) -> str:
    return f"""WITH RECURSIVE {EVENTS_CTE},
g(s) AS (
  SELECT 0.0::DOUBLE
  UNION ALL
  SELECT s + {stride}::DOUBLE FROM g WHERE s + {stride}::DOUBLE + {size}::DOUBLE <= {DURATION})
SELECT path, s AS start_sec, s + {size}::DOUBLE AS end_sec,
       round(s + {size}::DOUBLE - s, 6) AS duration_sec
FROM rec, g"""


def _labels(drop: bool) -> str:
    partial = "NULL, false, 'partial_overlap_dropped'"
    if not drop:
        partial = "0, true, 'partial_overlap_assigned_negative'"
    label, keep, reason = partial.split(", ")
    return f"""WITH {_ratio_ctes(3600, 3600)}
SELECT path, ws AS start_sec,
  CAST(CASE WHEN ratio >= 0.5 THEN 1 WHEN ratio = 0 THEN 0 ELSE {label} END AS BIGINT) AS label,
  CASE WHEN ratio >= 0.5 OR ratio = 0 THEN true ELSE {keep} END AS keep,
  CASE WHEN ratio >= 0.5 THEN 'positive_overlap_threshold_reached'
       WHEN ratio = 0 THEN 'no_overlap' ELSE {reason} END AS reason
FROM rat"""


SEGMENTS = f"""WITH {_ratio_ctes(3600, 3600)},
segs AS (
  SELECT subject, 'ses-01' AS session, '00' AS run, path,
         {DURATION}::DOUBLE AS recording_duration_sec, ws AS start_sec, we AS end_sec,
         3600.0::DOUBLE AS window_size_sec, 3600.0::DOUBLE AS stride_sec,
         round(ratio, 6) AS overlap_ratio,
         CAST(CASE WHEN ratio >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS label
  FROM rat WHERE ratio >= 0.5 OR ratio = 0)
"""

THRESHOLDS = f"""WITH {_ratio_ctes(3600, 3600)}
SELECT t AS threshold, d AS drop_partial,
       count(*) FILTER (ratio >= t) AS n_positive,
       count(*) FILTER (CASE WHEN d THEN ratio = 0 ELSE ratio < t END) AS n_negative
FROM rat, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) a(t), (VALUES (true), (false)) b(d)
GROUP BY t, d"""

_FILE = """'sub-' || user_id || '_ses-' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '_task-'
  || event_type || '_run-' || event_id"""

PARSED = f"""
SELECT event_id, 'sub-' || user_id AS subject,
       'ses-' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS session, event_type AS task,
       CAST(event_id AS VARCHAR) AS run, 'eeg' AS suffix, {_FILE} || '_eeg.edf' AS filename
FROM events"""

ENTITIES = """
SELECT event_id, unnest(['sub', 'ses', 'task', 'run', 'suffix']) AS key,
       unnest([CAST(user_id AS VARCHAR), lpad(CAST(day(ts) AS VARCHAR), 2, '0'), event_type,
               CAST(event_id AS VARCHAR), 'eeg']) AS value
FROM events"""

NORMALISED = """
norm AS (
  SELECT event_id,
         CASE event_type WHEN 'error' THEN 'sz_error' WHEN 'purchase' THEN 'sz'
              WHEN 'click' THEN 'bckg' ELSE '' END AS event_type,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS onset,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS duration
  FROM events)"""


# --- audit -------------------------------------------------------------------------


def _summary_ctes(rows: str) -> str:
    return f"""rows_ AS ({rows}),
base AS (
  SELECT subject, count(*) AS n_segments, CAST(sum(label) AS BIGINT) AS n_positive,
         count(DISTINCT rec) AS n_recordings
  FROM rows_ GROUP BY subject),
tot AS (SELECT CAST(greatest(sum(n_positive), 1) AS DOUBLE) AS tp,
               CAST(sum(n_segments) AS DOUBLE) AS ts FROM base),
summ AS (
  SELECT subject, n_segments, n_positive, n_segments - n_positive AS n_negative,
         n_positive / CAST(n_segments AS DOUBLE) AS positive_ratio, n_recordings,
         n_positive > 0 AS has_positive, n_positive / tp AS positive_share_overall,
         n_segments / ts AS segment_share_overall
  FROM base, tot)"""


def _event_rows(rare: bool) -> str:
    extra = " AND value > 150" if rare else ""
    return f"""SELECT CAST(user_id AS VARCHAR) AS subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS rec,
         CAST(event_type = 'error'{extra} AS INTEGER) AS label FROM events"""


RARE = _summary_ctes(_event_rows(True))
COMMON = _summary_ctes(_event_rows(False))
DOCUMENTS = _summary_ctes(
    f"""SELECT d.source AS subject, d.lang AS rec, l.toxic AS label
  FROM documents d JOIN labels l ON {DOC_KEYS}"""
)

SUMMARY_COLUMNS = """subject, n_segments, n_positive, n_negative,
  round(positive_ratio, 6) AS positive_ratio, n_recordings, has_positive,
  round(positive_share_overall, 6) AS positive_share_overall,
  round(segment_share_overall, 6) AS segment_share_overall"""

GLOBAL_CTE = """
gl AS (
  SELECT CAST(sum(n_segments) AS BIGINT) AS total_segments,
         CAST(sum(n_positive) AS BIGINT) AS total_positive,
         CAST(sum(n_segments) - sum(n_positive) AS BIGINT) AS total_negative,
         sum(n_positive) / CAST(sum(n_segments) AS DOUBLE) AS global_positive_ratio,
         count(*) AS total_subjects,
         count(*) FILTER (has_positive) AS subjects_with_positive,
         count(*) FILTER (NOT has_positive) AS subjects_without_positive,
         count(*) FILTER (has_positive) / CAST(count(*) AS DOUBLE) AS subject_positive_ratio
  FROM summ)"""

CONCENTRATION_CTE = """
rk AS (
  SELECT positive_share_overall p, segment_share_overall s,
         row_number() OVER (ORDER BY n_positive DESC) rp,
         row_number() OVER (ORDER BY n_segments DESC) rs
  FROM summ),
conc AS (
  SELECT sum(p) FILTER (rp <= 1) AS top_1_positive_share,
         sum(p) FILTER (rp <= 3) AS top_3_positive_share,
         sum(p) FILTER (rp <= 5) AS top_5_positive_share,
         sum(s) FILTER (rs <= 1) AS top_1_segment_share,
         sum(s) FILTER (rs <= 3) AS top_3_segment_share,
         sum(s) FILTER (rs <= 5) AS top_5_segment_share
  FROM rk)"""


def _distribution(summary: str) -> str:
    blocks = " UNION ALL ".join(
        f"""SELECT '{c}_per_subject' AS block, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(avg({c}), 6) AS mean,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
  round(CAST(max({c}) AS DOUBLE), 6) AS max, round(stddev_pop({c}), 6) AS std FROM summ"""
        for c in ("n_segments", "n_positive", "n_negative", "positive_ratio")
    )
    return f"WITH {summary} {blocks}"


def _flags(summary: str) -> str:
    return f"""WITH {summary},{GLOBAL_CTE},{CONCENTRATION_CTE},
small AS (SELECT avg(CASE WHEN n_segments < 50 THEN 1.0 ELSE 0.0 END) AS f,
                 count(*) FILTER (n_positive = 0) AS z FROM summ)
SELECT total_subjects < 15 AS few_total_subjects,
  total_subjects < 10 AS very_few_total_subjects,
  subjects_with_positive < 6 AS few_positive_subjects,
  subjects_with_positive < 4 AS very_few_positive_subjects,
  subject_positive_ratio < 0.5 AS many_subjects_without_positive,
  top_1_positive_share >= 0.40 AS positives_highly_concentrated_top1,
  top_3_positive_share >= 0.75 AS positives_highly_concentrated_top3,
  top_1_segment_share >= 0.25 AS segments_highly_concentrated_top1,
  top_3_segment_share >= 0.50 AS segments_highly_concentrated_top3,
  f >= 0.20 AS has_many_very_small_subjects, z > 0 AS has_zero_positive_subjects,
  CASE WHEN total_subjects < 10 THEN
    'Very few subjects: start with a subject-level hold-out split to move forward, but strongly consider subject-level cross-validation in the final evaluation.'
  WHEN subjects_with_positive < 4 THEN
    'Very few positive subjects: do not use a purely random subject split. Assign positive subjects in a controlled way to guarantee positives in validation and test.'
  WHEN top_3_positive_share >= 0.75 THEN
    'Positives are highly concentrated in a few subjects: use a subject-level hold-out split with controlled assignment of positive subjects before filling with negatives.'
  WHEN top_3_segment_share >= 0.50 THEN
    'Total segment volume is highly concentrated: use a subject-level hold-out split while also monitoring the total size of each split.'
  ELSE
    'The dataset seems compatible with a reproducible subject-level hold-out split. Still, explicitly verify that validation and test contain enough positive subjects.'
  END AS recommended_strategy
FROM gl, conc, small"""


# --- signals -----------------------------------------------------------------------

BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
# Adding 0.0 turns a rounded -0.0 into 0.0.
R9 = "round({}, 9) + 0.0"


def _time_ctes(key: str) -> str:
    """Time features of ``sig(key, i, x)``."""
    return f"""
steps AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY {key} ORDER BY i)) AS d FROM sig),
tf AS (
  SELECT {key}, avg(x) AS mean, stddev_pop(x) AS std, sqrt(avg(x * x)) AS rms,
         coalesce(sum(d), 0.0) AS line_length
  FROM steps GROUP BY {key})"""


def _welch_ctes(key: str, n: int, fs: float) -> str:
    """Band powers of ``sig(key, i, x)`` by Fourier sums over each segment."""
    m = min(n, int(2 * fs))
    step = m - m // 2
    count = (n - m) // step + 1
    norm = fs * sum((0.5 - 0.5 * math.cos(2 * math.pi * i / m)) ** 2 for i in range(m))
    df = fs / m
    cells = ",\n".join(
        f"""coalesce(sum((p + nxt) / 2 * {df}) FILTER (
             k * {df} >= {lo} AND k * {df} < {hi} AND (k + 1) * {df} < {hi}), 0.0) AS {name}"""
        for name, (lo, hi) in BANDS.items()
    )
    return f"""
cut AS (
  SELECT {key}, s, i - s * {step} AS j, x FROM sig, range(0, {count}) t(s)
  WHERE i >= s * {step} AND i < s * {step} + {m}),
tap AS (
  SELECT {key}, s, j,
         (x - avg(x) OVER (PARTITION BY {key}, s)) * (0.5 - 0.5 * cos(2 * pi() * j / {m})) AS y
  FROM cut),
dft AS (
  SELECT {key}, s, k, sum(y * cos(2 * pi() * k * j / {m})) AS re,
         sum(y * sin(2 * pi() * k * j / {m})) AS im
  FROM tap, range(0, {m // 2 + 1}) f(k) GROUP BY {key}, s, k),
psd AS (
  SELECT {key}, k,
         avg(re * re + im * im) / {norm!r} * CASE WHEN k = 0 OR 2 * k = {m} THEN 1 ELSE 2 END AS p
  FROM dft GROUP BY {key}, k),
nb AS (SELECT *, lead(p) OVER (PARTITION BY {key} ORDER BY k) AS nxt FROM psd),
bp AS (
  SELECT {key}, {cells}, sum((p + nxt) / 2 * {df}) AS total FROM nb GROUP BY {key})"""


VECTOR_SIGNAL = """sig AS (
  SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, range(1, 65) t(i))"""
MATRIX_SIGNAL = """sig AS (
  SELECT vec_id, CAST((i - 1) // 16 AS INTEGER) AS c, (i - 1) % 16 AS i,
         CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, range(1, 65) t(i))"""
MATRIX_CTES = f"{MATRIX_SIGNAL},{_time_ctes('vec_id, c')},{_welch_ctes('vec_id, c', 16, 64.0)}"

TIME_NAMES = ("mean", "std", "rms", "line_length")


def _relative(name: str) -> str:
    return f"CASE WHEN total > 0 THEN {name} / total ELSE 0.0 END"


def _wide_cells(
    channels: dict[int, str], time: bool = True, freq: bool = True, relative: bool = False
) -> str:
    """One column per feature and channel; absent channels are null."""
    cells = []
    for c, name in channels.items():
        for f in TIME_NAMES if time else ():
            value = R9.format(f"max(tf.{f}) FILTER (tf.c = {c})")
            cells.append(f"{value} AS {f}_{name}")
    for c, name in channels.items():
        for b in BANDS if freq else ():
            power = _relative(f"bp.{b}") if relative else f"bp.{b}"
            value = R9.format(f"max({power}) FILTER (bp.c = {c})")
            cells.append(f"{value} AS {b}_power_{name}")
    return ",\n".join(cells)


NUMBERED = {i: f"ch_{i + 1:02d}" for i in range(4)}
WIDE = f"""
wide AS (
  SELECT tf.vec_id, {_wide_cells(NUMBERED)}
  FROM tf JOIN bp USING (vec_id, c) GROUP BY tf.vec_id)"""
RAGGED = f"""
ragged AS (
  SELECT tf.vec_id, {_wide_cells(NUMBERED)}
  FROM tf JOIN bp USING (vec_id, c) WHERE tf.vec_id % 2 = 1 OR tf.c < 2 GROUP BY tf.vec_id)"""
WIDE_NAMES = [f"{f}_{n}" for n in NUMBERED.values() for f in TIME_NAMES] + [
    f"{b}_power_{n}" for n in NUMBERED.values() for b in BANDS
]


def _describe(columns: list[str], source: str, digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), {digits}) + 0.0 AS mean,
  round(stddev_samp({c}), {digits}) AS std, round(min({c}), {digits}) + 0.0 AS min,
  round(quantile_cont({c}, 0.25), {digits}) + 0.0 AS p25,
  round(quantile_cont({c}, 0.5), {digits}) + 0.0 AS p50,
  round(quantile_cont({c}, 0.75), {digits}) + 0.0 AS p75,
  round(max({c}), {digits}) + 0.0 AS max FROM {source}"""
        for c in columns
    )


def _time_kernel(name: str) -> str:
    return f"""WITH {VECTOR_SIGNAL},{_time_ctes('vec_id')}
SELECT vec_id, {R9.format(name)} AS {name} FROM tf"""


VECTOR_BANDS = f"WITH {VECTOR_SIGNAL},{_welch_ctes('vec_id', 64, 64.0)}"

CROP = """WITH b AS (
  SELECT vec_id, embedding, (vec_id % 7) * 0.05::DOUBLE AS s FROM embeddings),
c AS (
  SELECT vec_id, embedding, CAST(round_even(s * 64, 0) AS INTEGER) AS f,
         least(CAST(round_even((s + 0.3::DOUBLE + (vec_id % 5) * 0.1171875::DOUBLE) * 64, 0)
               AS INTEGER), 64) AS l
  FROM b)
SELECT vec_id, CAST(l - f AS INTEGER) AS n_samples,
       round(CAST(embedding[f + 1] AS DOUBLE), 9) + 0.0 AS first,
       round(list_sum([CAST(v AS DOUBLE) FOR v IN embedding[f + 1:l]]), 9) + 0.0 AS total
FROM c"""

# --- files: the table the recordings were written from ------------------------------

FILES_CTE = """
cell AS (
  SELECT CAST(vec_id // 40 AS BIGINT) AS rec, CAST((vec_id // 4) % 10 AS BIGINT) AS sec,
         CAST(vec_id % 4 AS INTEGER) AS c, embedding, label
  FROM embeddings),
named AS (
  SELECT *, 'sub-' || lpad(CAST(rec % 5 AS VARCHAR), 2, '0') AS subject,
         lpad(CAST(rec AS VARCHAR), 4, '0') AS run
  FROM cell),
recs AS (
  SELECT rec, subject, run, subject || '_ses-01_task-monitor_run-' || run AS name,
         count(DISTINCT sec) AS secs
  FROM named GROUP BY ALL),
ann AS (
  SELECT rec, name || '_events.tsv' AS filename, CAST(sec AS DOUBLE) AS onset,
         1.0::DOUBLE AS duration, CASE WHEN label < 3 THEN 'sz_foc_a' ELSE 'bckg' END AS event_type
  FROM named JOIN recs USING (rec) WHERE c = 0),
smp AS (
  SELECT rec, sec, c, i - 1 AS i,
         round_even((CAST(embedding[i] AS DOUBLE) + 1) * 32767.5 - 32768, 0) * (2 / 65535.0::DOUBLE)
         + (-1 + 32768 * (2 / 65535.0::DOUBLE)) AS x
  FROM named, range(1, 65) t(i))"""

FILE_SEGMENTS_CTE = """
fwin AS (
  SELECT recs.*, k * 2.0::DOUBLE AS ws, k * 2.0::DOUBLE + 4 AS we
  FROM recs, range(0, 4) t(k) WHERE k * 2 + 4 <= secs),
fcov AS (
  SELECT w.*, (SELECT count(*) FROM ann a WHERE a.rec = w.rec AND a.event_type = 'sz_foc_a'
               AND a.onset >= w.ws AND a.onset < w.we) / 4.0::DOUBLE AS ratio
  FROM fwin w),
fseg AS (
  SELECT name || '_eeg.edf' AS filename, rec, subject, 'ses-01' AS session, run,
         CAST(secs AS DOUBLE) AS recording_duration_sec, ws AS start_sec, we AS end_sec,
         4.0::DOUBLE AS window_size_sec, 2.0::DOUBLE AS stride_sec, ratio AS overlap_ratio,
         CAST(ratio >= 0.5 AS BIGINT) AS label
  FROM fcov WHERE ratio >= 0.5 OR ratio = 0)"""

FILE_SIGNAL_CTE = """
sig AS (
  SELECT f.rec, f.start_sec AS ws, s.c, CAST((s.sec - f.start_sec) * 64 + s.i AS BIGINT) AS i, s.x
  FROM fseg f JOIN smp s ON s.rec = f.rec AND s.sec >= f.start_sec AND s.sec < f.end_sec)"""


def _file_features(relative: bool) -> str:
    key = "rec, ws, c"
    return f"""WITH {FILES_CTE},{FILE_SEGMENTS_CTE},{FILE_SIGNAL_CTE},{_time_ctes(key)},
{_welch_ctes(key, 256, 64.0)},
w AS (
  SELECT tf.rec, tf.ws, {_wide_cells(NUMBERED, relative=relative)}
  FROM tf JOIN bp USING (rec, ws, c) GROUP BY tf.rec, tf.ws)
SELECT filename, subject, session, f.run, start_sec, end_sec, label, w.* EXCLUDE (rec, ws)
FROM fseg f JOIN w ON w.rec = f.rec AND w.ws = f.start_sec"""


FILE_PARTS = f"""SELECT 'features_part_' || lpad(CAST(dense_rank() OVER (ORDER BY filename) - 1 AS VARCHAR), 4, '0')
       || '.parquet' AS part,
       row_number() OVER (PARTITION BY filename ORDER BY start_sec) - 1 AS row, f.*
FROM ({_file_features(False)}) f"""

NOTED_CTE = """
noted AS (
  SELECT 'log-' || lpad(CAST(event_id // 1000 AS VARCHAR), 6, '0') || '_events.tsv' AS filename, event_id,
         CAST(event_id * 7 % 250 AS DOUBLE) AS onset, value AS duration,
         CASE event_type WHEN 'error' THEN 'sz_a' WHEN 'click' THEN 'sz_b' ELSE 'bckg' END AS event_type
  FROM events)"""

FILE_MANIFEST = f"""WITH {FILES_CTE}
SELECT subject, 'ses-01' AS session, 'monitor' AS task, run, name || '_eeg.edf' AS filename
FROM recs"""

CHECKSUMS = f"""WITH {FILES_CTE},
ln AS (
  SELECT filename, rec, onset,
         CASE WHEN rec % 2 = 1
              THEN '1.0' || chr(9) || event_type || chr(9) || 'all' || chr(9)
                   || CAST(onset AS BIGINT)
              ELSE CAST(onset AS BIGINT) || chr(9) || '1.0' || chr(9) || event_type END AS line
  FROM ann)
SELECT filename,
       md5(CASE WHEN rec % 2 = 1 THEN concat_ws(chr(9), 'duration', 'eventType', 'channels', 'onset')
           ELSE concat_ws(chr(9), 'onset', 'duration', 'eventType ') END
           || chr(10) || string_agg(line, chr(10) ORDER BY onset) || chr(10)) AS md5
FROM ln GROUP BY filename, rec"""

SEGMENT_SUMMARY = f"""{SEGMENTS.removeprefix('WITH ')},
{_summary_ctes("SELECT subject, run AS rec, label FROM segs")}"""
GLOBAL_NAMES = (
    "total_segments total_positive total_negative global_positive_ratio total_subjects subjects_with_positive "
    "subjects_without_positive subject_positive_ratio"
).split()
SHARE_NAMES = [f"top_{k}_{what}_share" for k in (1, 3, 5) for what in ("positive", "segment")]
STATISTICS = "min p25 median mean p75 max std".split()
FLAG_NAMES = (
    "few_total_subjects very_few_total_subjects few_positive_subjects very_few_positive_subjects "
    "many_subjects_without_positive positives_highly_concentrated_top1 positives_highly_concentrated_top3 "
    "segments_highly_concentrated_top1 segments_highly_concentrated_top3 has_many_very_small_subjects "
    "has_zero_positive_subjects recommended_strategy"
).split()
SEGMENT_COLUMNS = (
    "subject session run path recording_duration_sec start_sec end_sec window_size_sec stride_sec overlap_ratio label"
).split()
SUMMARY_NAMES = (
    "subject n_segments n_positive n_negative positive_ratio n_recordings has_positive positive_share_overall segment_share_overall"
).split()


def _long(source: str, names: list[str], block: str, kind: str) -> str:
    """(block, name, v) rows of the named columns."""
    return " UNION ALL ".join(f"SELECT {block} AS block, '{c}' AS name, CAST({c} AS {kind}) AS v FROM {source}" for c in names)


_REPORT = f"""WITH g_ AS (WITH {SEGMENT_SUMMARY},{GLOBAL_CTE},{CONCENTRATION_CTE} SELECT * FROM gl, conc),
s_ AS ({_distribution(SEGMENT_SUMMARY)}),
f_ AS ({_flags(SEGMENT_SUMMARY)}),
sum_ AS (WITH {SEGMENT_SUMMARY} SELECT * FROM summ),
num AS ({_long("g_", GLOBAL_NAMES, "'global_summary'", "DOUBLE")} UNION ALL {_long("g_", SHARE_NAMES, "'concentration'", "DOUBLE")}
  UNION ALL {_long("s_", STATISTICS, "block", "DOUBLE")}),
txt AS ({_long("f_", FLAG_NAMES, "'risk_flags'", "VARCHAR")}
  UNION ALL SELECT 'metadata', 'columns', '{','.join(SEGMENT_COLUMNS)}'
  UNION ALL SELECT 'metadata', 'recording_column_used', 'run'
  UNION ALL SELECT 'metadata', 'n_rows_dataset', CAST(CAST(total_segments AS BIGINT) AS VARCHAR) FROM g_)"""

JSON_REPORT = f"""{_REPORT}
SELECT block, name, NULL::VARCHAR AS text, round(v, 6) AS value FROM num
UNION ALL SELECT block, name, v, NULL FROM txt"""


def _table_cells(section: int, order: str, limit: int, where: str = "true") -> str:
    """(section, block, row, name, cell) of a preview table."""
    ranked = f"(SELECT *, row_number() OVER (ORDER BY {order}) AS row FROM sum_ WHERE {where} QUALIFY row <= {limit})"
    cell = lambda c: (
        f"CAST(round({c}, 4) AS VARCHAR)" if c.endswith(("ratio", "overall"))
        else f"CASE WHEN {c} THEN 'True' ELSE 'False' END" if c == "has_positive" else f"CAST({c} AS VARCHAR)"
    )
    return " UNION ALL ".join(f"SELECT {section}, NULL, CAST(row AS INT), '{c}', {cell(c)} FROM {ranked}" for c in SUMMARY_NAMES)


_BY_POSITIVE = "n_positive DESC, n_segments DESC, subject"
MARKDOWN_REPORT = f"""{_REPORT},
md(section, block, row, name, cell) AS (
  SELECT 1, NULL, 0, 'Number of rows', v FROM txt WHERE name = 'n_rows_dataset'
  UNION ALL SELECT 1, NULL, 0, 'Columns', replace(v, ',', ', ') FROM txt WHERE name = 'columns'
  UNION ALL SELECT 1, NULL, 0, 'Recording column used', v FROM txt WHERE name = 'recording_column_used'
  UNION ALL SELECT 2, NULL, 0, name, CAST(v AS VARCHAR) FROM num WHERE block = 'global_summary'
  UNION ALL SELECT 3, block, 0, name, CAST(round(v, 6) AS VARCHAR) FROM num WHERE block LIKE '%_per_subject'
  UNION ALL SELECT 4, NULL, 0, name, CAST(round(v, 6) AS VARCHAR) FROM num WHERE block = 'concentration'
  UNION ALL SELECT 5, NULL, 0, name, CASE v WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE v END FROM txt WHERE block = 'risk_flags'
  UNION ALL {_table_cells(6, _BY_POSITIVE, 10)}
  UNION ALL {_table_cells(7, "n_segments DESC, n_positive DESC, subject", 10)}
  UNION ALL {_table_cells(8, "n_segments DESC, subject", 10, "n_positive = 0")}
  UNION ALL {_table_cells(9, _BY_POSITIVE, 20)})
SELECT section, block, row, name, CASE WHEN TRY_CAST(cell AS DOUBLE) IS NULL THEN cell END AS text,
       round(TRY_CAST(cell AS DOUBLE), 6) AS value FROM md"""

NULLABLE = (
    "subject", "session", "run", "path", "recording_duration_sec", "start_sec", "end_sec",
    "window_size_sec", "stride_sec", "overlap_ratio", "label",
)

DUCKDB_SQL: dict[str, str] = {
    "seg_windows": _windows(3600, 3600),
    "seg_windows_sliding": _windows(7200, 1800),
    "seg_windows_gapped": _windows(3600, 10800),
    "seg_windows_drifting": _drifting(1800.3, 4321.1),
    "seg_overlap_pairs": f"""WITH {EVENTS_CTE},{_grid(3600, 3600)}
SELECT path, ws AS start_sec, round(onset, 6) AS onset_sec, round(fin, 6) AS interval_end_sec,
       round(least(we, fin) - greatest(ws, onset), 6) AS overlap_sec
FROM win w JOIN iv i ON w.user_id = i.user_id AND i.onset < w.we AND i.fin > w.ws
WHERE least(we, fin) - greatest(ws, onset) > 0""",
    "seg_overlap_long": f"""WITH {EVENTS_CTE},{_grid(900, 900)},
firsts AS (SELECT user_id, user_id % 5 AS kind, min(onset) AS onset FROM iv GROUP BY ALL),
long AS (
  SELECT user_id, CASE WHEN kind <> 1 THEN onset END AS onset,
         CASE WHEN kind <> 2 THEN onset + 900.0 * CASE WHEN kind = 0 THEN 400 ELSE 100 END END AS fin
  FROM firsts WHERE user_id % 7 <> 0)
SELECT path, ws AS start_sec, round(onset, 6) AS onset_sec, round(fin, 6) AS interval_end_sec,
       round(least(we, coalesce(fin, we)) - greatest(ws, coalesce(onset, ws)), 6) AS overlap_sec
FROM win w JOIN long i ON w.user_id = i.user_id
WHERE least(we, coalesce(fin, we)) - greatest(ws, coalesce(onset, ws)) > 0""",
    "seg_total_overlap": f"""WITH {_ratio_ctes(3600, 3600)}
SELECT path, ws AS start_sec, we AS end_sec, round(overlap_sec, 6) AS overlap_sec FROM cov""",
    "seg_ratio": f"""WITH {_ratio_ctes(3600, 3600)}
SELECT path, ws AS start_sec, round(ratio, 6) AS overlap_ratio FROM rat""",
    "seg_ratio_sliding": f"""WITH {_ratio_ctes(7200, 1800)}
SELECT path, ws AS start_sec, round(ratio, 6) AS overlap_ratio FROM rat""",
    "assign_label_drop": _labels(True),
    "assign_label_keep": _labels(False),
    "label_reason_counts": f"SELECT reason, count(*) AS n FROM ({_labels(True)}) GROUP BY reason",
    "segments_dataset": f"{SEGMENTS} SELECT * FROM segs",
    "limit_segments": f"{SEGMENTS} SELECT * FROM segs ORDER BY subject, path, start_sec LIMIT 1000",
    "threshold_study": THRESHOLDS,
    "parse_bids": PARSED,
    "parse_entities": ENTITIES,
    "events_path": f"""SELECT event_id,
  '/data/sub-' || user_id || '/' || {_FILE} || '_events.tsv' AS events_path FROM events""",
    "norm_event_type": f"WITH {NORMALISED} SELECT event_id, event_type FROM norm",
    "is_seizure": f"""WITH {NORMALISED}
SELECT event_type, starts_with(event_type, 'sz') AS is_seizure, count(*) AS n
FROM norm GROUP BY event_type""",
    "coerce_nonneg": f"WITH {NORMALISED} SELECT event_id, duration AS duration_sec FROM norm",
    "extract_intervals": f"""WITH {NORMALISED}
SELECT event_id, round(onset, 6) AS onset_sec, round(duration, 6) AS duration_sec,
       round(onset + duration, 6) AS end_sec, event_type
FROM norm WHERE starts_with(event_type, 'sz')""",
    "safe_str": """SELECT event_id, CAST(user_id AS VARCHAR) AS session, CAST(NULL AS VARCHAR) AS run
FROM events""",
    "channel_names": """SELECT p_partkey,
  'ch_' || CASE WHEN p_partkey % 150 + 1 < 10 THEN '0' ELSE '' END || (p_partkey % 150 + 1)
    AS channel_name FROM part""",
    "subject_summary": f"WITH {RARE} SELECT {SUMMARY_COLUMNS} FROM summ",
    "subject_summary_common": f"WITH {COMMON} SELECT {SUMMARY_COLUMNS} FROM summ",
    "subject_summary_documents": f"WITH {DOCUMENTS} SELECT {SUMMARY_COLUMNS} FROM summ",
    "global_summary": f"""WITH {RARE},{GLOBAL_CTE}
SELECT * REPLACE (round(global_positive_ratio, 6) AS global_positive_ratio,
                  round(subject_positive_ratio, 6) AS subject_positive_ratio) FROM gl""",
    "distribution_stats": _distribution(RARE),
    "concentration": f"""WITH {RARE},{CONCENTRATION_CTE}
SELECT round(COLUMNS(*), 6) FROM conc""",
    "risk_flags": _flags(RARE),
    "risk_flags_documents": _flags(DOCUMENTS),
    "topk_positive": f"""WITH {RARE} SELECT {SUMMARY_COLUMNS} FROM summ
ORDER BY n_positive DESC, n_segments DESC, subject LIMIT 10""",
    "topk_segments": f"""WITH {RARE} SELECT {SUMMARY_COLUMNS} FROM summ
ORDER BY n_segments DESC, n_positive DESC, subject LIMIT 10""",
    "topk_zero_positive": f"WITH {RARE} SELECT {SUMMARY_COLUMNS} FROM summ WHERE n_positive = 0",
    "value_counts": f"{SEGMENTS} SELECT label, count(*) AS n FROM segs GROUP BY label",
    "duration_counts": f"""{SEGMENTS}
SELECT round(end_sec - start_sec, 6) AS duration_sec, count(*) AS n FROM segs GROUP BY 1
ORDER BY n DESC LIMIT 5""",
    # The statistics see unrounded ratios.
    "describe": SEGMENTS.replace("round(ratio, 6)", "ratio")
    + _describe(["overlap_ratio"], "segs", 6),
    "describe_features": f"WITH {MATRIX_CTES},{WIDE.replace('round(', '(').replace(', 9)', ')')} "
    + _describe(WIDE_NAMES[:10], "wide", 9),
    "null_counts": SEGMENTS
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing FROM segs" for c in NULLABLE
    ),
    "feature_nulls": f"WITH {MATRIX_CTES},{RAGGED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing FROM ragged"
        for c in ["vec_id", *WIDE_NAMES]
    ),
    "unique_values": f"{SEGMENTS} SELECT DISTINCT window_size_sec FROM segs",
    "nunique": f"""{SEGMENTS}
SELECT count(DISTINCT subject) AS n_subject, count(DISTINCT path) AS n_path FROM segs""",
    "negative_power": f"WITH {MATRIX_CTES},{WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, bool_or({c} < 0) AS has_negative FROM wide"
        for c in WIDE_NAMES
        if "power_" in c
    ),
    **{f"feat_{name}": _time_kernel(name) for name in TIME_NAMES},
    "feat_bandpower_abs": f"{VECTOR_BANDS} SELECT vec_id, {R9.format('alpha')} AS alpha FROM bp",
    "feat_bandpower_rel": f"""{VECTOR_BANDS}
SELECT vec_id, {R9.format(_relative('alpha'))} AS alpha FROM bp""",
    "feat_standard_bands": f"""{VECTOR_BANDS}
SELECT vec_id, {', '.join(f'{R9.format(b)} AS {b}_power' for b in BANDS)} FROM bp""",
    "feat_time_channels": f"""WITH {MATRIX_SIGNAL},{_time_ctes('vec_id, c')}
SELECT vec_id, {_wide_cells(NUMBERED, freq=False)} FROM tf GROUP BY vec_id""",
    "feat_freq_channels": f"""WITH {MATRIX_SIGNAL},{_welch_ctes('vec_id, c', 16, 64.0)}
SELECT vec_id, {_wide_cells(dict(enumerate(['Fz', 'Cz', 'Pz', 'Oz'])), time=False, relative=True)}
FROM bp GROUP BY vec_id""",
    "feat_all_channels": f"WITH {MATRIX_CTES},{WIDE} SELECT * FROM wide",
    "feat_concat_ragged": f"WITH {MATRIX_CTES},{RAGGED} SELECT * FROM ragged",
    "crop_samples": CROP,
    "src_manifest": FILE_MANIFEST,
    "src_load_manifest": FILE_MANIFEST,
    "src_entities": f"""WITH {FILES_CTE}
SELECT name || '_eeg.edf' AS filename, unnest(['sub', 'ses', 'task', 'run', 'suffix']) AS key,
       unnest([replace(subject, 'sub-', ''), '01', 'monitor', run, 'eeg']) AS value
FROM recs""",
    "src_edf_header": f"""WITH {FILES_CTE}
SELECT name || '_eeg.edf' AS filename, 4::INTEGER AS n_channels, 64.0::DOUBLE AS sfreq,
       CAST(secs * 64 AS BIGINT) AS n_samples, CAST(secs AS DOUBLE) AS duration_sec,
       'EEG 0,EEG 1,EEG 2,EEG 3' AS channel_names
FROM recs""",
    "src_edf_samples": f"""WITH {FILES_CTE}
SELECT name || '_eeg.edf' AS filename, c AS channel, CAST(sec AS DOUBLE) AS start_sec,
       CAST(count(*) AS INTEGER) AS n_samples, round(sqrt(avg(x * x)), 9) AS rms,
       round(avg(x), 9) + 0.0 AS mean
FROM smp JOIN recs USING (rec) GROUP BY name, c, sec""",
    "src_events_tsv": f"WITH {FILES_CTE} SELECT * EXCLUDE (rec) FROM ann",
    "src_intervals": f"""WITH {FILES_CTE}
SELECT filename, onset AS onset_sec, duration AS duration_sec, onset + duration AS end_sec,
       event_type FROM ann WHERE event_type <> 'bckg'""",
    "src_annotations": f"""WITH {FILES_CTE}
SELECT * EXCLUDE (rec) FROM ann WHERE filename = (SELECT min(filename) FROM ann)
ORDER BY onset LIMIT 10""",
    "segments_from_files": f"""WITH {FILES_CTE},{FILE_SEGMENTS_CTE}
SELECT * EXCLUDE (rec) FROM fseg""",
    "features_from_files": _file_features(False),
    "features_from_files_relative": _file_features(True),
    "sink_feature_parts": FILE_PARTS,
    "sink_segments": f"{SEGMENTS} SELECT * FROM segs",
    "sink_features": _file_features(False),
    "sink_csv": f"""WITH {RARE}, csv AS (SELECT {SUMMARY_COLUMNS} FROM summ)
SELECT * REPLACE (CASE WHEN has_positive THEN 'True' ELSE 'False' END AS has_positive),
       row_number() OVER (ORDER BY n_positive DESC, n_segments DESC, subject) - 1 AS place
FROM csv""",
    "sink_json": JSON_REPORT,
    "sink_markdown": MARKDOWN_REPORT,
    "src_checksums": CHECKSUMS,
    "src_edf_stretch": f"""WITH {FILES_CTE}
SELECT name || '_eeg.edf' AS filename, c AS channel, CAST(sec AS DOUBLE) AS start_sec,
       CAST(count(*) AS INTEGER) AS n_samples, round(sum(x), 9) + 0.0 AS total
FROM smp JOIN recs USING (rec) WHERE subject = 'sub-00' AND c IN (1, 3) AND sec BETWEEN 2 AND 5 GROUP BY name, c, sec""",
    "src_events_quoted": f"WITH {NOTED_CTE} SELECT * EXCLUDE (event_id) FROM noted",
    "sort_intervals": f"""WITH {NOTED_CTE}
SELECT filename, onset AS onset_sec, round(duration, 6) AS duration_sec, round(onset + duration, 6) AS end_sec, event_type,
       CAST(row_number() OVER (PARTITION BY filename ORDER BY onset, event_id) - 1 AS INT) AS place
FROM noted WHERE event_type <> 'bckg'""",
    "unique_values_ordered": """
SELECT event_type || '-' || day(ts) AS value, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INT) AS place
FROM events GROUP BY 1""",
    "preview_head": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 25",
    "agg_non_numeric": """
SELECT unnest(['rising', 'kind']) AS "column",
       unnest([count(DISTINCT list_sum(list_transform(embedding[1:16], lambda v: CAST(v AS DOUBLE))) > 0),
               count(DISTINCT CAST(label AS VARCHAR))]) AS n_values
FROM embeddings""",
    "validate_dataset": """
SELECT CAST(user_id AS VARCHAR) AS subject, CAST(event_type = 'error' AS BIGINT) AS label,
       count(*) AS n
FROM events GROUP BY ALL""",
}
