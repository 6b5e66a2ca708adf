"""Each catalogue query as SQL for DuckDB: plain definitions of what operators compute.

Low-pass, high-pass and notch coefficients are SQL expressions of the design formulas; pipelines, presets and profiles
are read off the engine's own objects, so SQL can't tell if one of their parameters is wrong (tests of those can).
"""

from __future__ import annotations

from sparkwave import queries as q
from sparkwave.functions.patterns import KINDS, PRESETS, Pattern
from sparkwave.plans import profiles

SAMPLES = """samples AS MATERIALIZED (
  SELECT (user_id % 16)::INT AS channel, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS idx, value AS x
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def with_(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def designed(kind: str, frequency: float, q_factor: float = 0.0, rate: float = 1000.0) -> str:
    """Coefficients b0, b1, b2, a1, a2 by the formulas: bilinear second-order Butterworth, or notch."""
    if kind == "notch":
        w, c = f"2 * pi() * {frequency} / {rate}", "1 + alpha"
        return f"SELECT 1 / ({c}) AS b0, -2 * cos(w) / ({c}) AS b1, 1 / ({c}) AS b2, -2 * cos(w) / ({c}) AS a1, (1 - alpha) / ({c}) AS a2 FROM (SELECT {w} AS w, sin({w}) / (2 * {q_factor}) AS alpha)"
    top = {"lowpass": ("k * k", "2 * k * k"), "highpass": ("1", "-2")}[kind]
    d = "(1 + sqrt(2) * k + k * k)"
    return f"SELECT {top[0]} / {d} AS b0, {top[1]} / {d} AS b1, {top[0]} / {d} AS b2, 2 * (k * k - 1) / {d} AS a1, (1 - sqrt(2) * k + k * k) / {d} AS a2 FROM (SELECT tan(pi() * {frequency} / {rate}) AS k)"


#: The queries whose sections SQL designs itself.
DESIGNS = {
    "highpass_20": [("highpass", 20.0)], "highpass_10": [("highpass", 10.0)], "lowpass_450": [("lowpass", 450.0)], "bandpass_20_450": [
        ("highpass", 20.0), ("lowpass", 450.0)
    ],
    "notch_50_q10": [("notch", 50.0, 10.0)], "notch_50_q30": [("notch", 50.0, 30.0)], "notch_60_q50": [("notch", 60.0, 50.0)],
}


def recursion(sections, source: str = "samples", prefix: str = "f") -> tuple[list[str], str]:
    """One recursive table for each section (numbers, or a design): a sample from the one before."""
    ctes = []
    for j, section in enumerate(sections):
        name = f"{prefix}{j}"
        if isinstance(section[0], str):
            ctes.append(f"{name}c AS MATERIALIZED ({designed(*section)})")
            ctes.append(f"""{name}r(channel, idx, x1, x2, y1, y2) AS (
  SELECT channel, idx, x, 0.0::DOUBLE, b0 * x, 0.0::DOUBLE FROM {source}, {name}c WHERE idx = 0
  UNION ALL
  SELECT s.channel, s.idx, s.x, f.x1, b0 * s.x + b1 * f.x1 + b2 * f.x2 - a1 * f.y1 - a2 * f.y2, f.y1
  FROM {name}r f JOIN {source} s ON s.channel = f.channel AND s.idx = f.idx + 1, {name}c),
{name} AS MATERIALIZED (SELECT channel, idx, y1 AS x FROM {name}r)""")
            source = name
            continue
        b0, b1, b2, a1, a2 = section
        ctes.append(f"""{name}r(channel, idx, x1, x2, y1, y2) AS (
  SELECT channel, idx, x, 0.0::DOUBLE, ({b0!r}::DOUBLE) * x, 0.0::DOUBLE FROM {source} WHERE idx = 0
  UNION ALL
  SELECT s.channel, s.idx, s.x, f.x1, ({b0!r}::DOUBLE) * s.x + ({b1!r}::DOUBLE) * f.x1 + ({b2!r}::DOUBLE) * f.x2 - ({a1!r}::DOUBLE) * f.y1 - ({a2!r}::DOUBLE) * f.y2, f.y1
  FROM {name}r f JOIN {source} s ON s.channel = f.channel AND s.idx = f.idx + 1),
{name} AS MATERIALIZED (SELECT channel, idx, y1 AS x FROM {name}r)""")
        source = name
    return ctes, source


def windowed(source: str, size: int = q.SIZE, hop: int = q.SIZE // 2) -> list[str]:
    return [
        f"""w AS (
  SELECT * EXCLUDE (k), k::BIGINT AS k, idx - k * {hop} AS j FROM (SELECT channel, idx, x, unnest(range(greatest(0, (idx - {size} + {hop}) // {hop}), idx // {hop} + 1)) AS k FROM {source})),
full_w AS MATERIALIZED (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY channel, k) = {size})"""
    ]


TIME = """tf AS (
  SELECT channel, k, avg(x) AS mean, sqrt(avg(x * x)) AS rms, avg(abs(x)) AS mav,
         count(*) FILTER (j >= 1 AND ((x >= 0 AND x1 < 0) OR (x < 0 AND x1 >= 0))) AS zero_crossings,
         sum(CASE WHEN j >= 1 THEN abs(x - x1) ELSE 0 END) AS waveform_length,
         count(*) FILTER (j >= 2 AND (x > x1) <> (x1 > x2)) AS slope_sign_changes,
         var_pop(x) AS variance, stddev_pop(x) AS std_dev, min(x) AS min_value, max(x) AS max_value, max(x) - min(x) AS peak_to_peak
  FROM (SELECT *, lag(x, 1) OVER v AS x1, lag(x, 2) OVER v AS x2 FROM full_w WINDOW v AS (PARTITION BY channel, k ORDER BY j)) GROUP BY 1, 2)"""
STATISTICS = """m AS (SELECT *, avg(x) OVER v AS mu, min(x) OVER v AS lo, max(x) OVER v AS hi FROM full_w WINDOW v AS (PARTITION BY channel, k)),
mom AS (
  SELECT channel, k, coalesce(avg((x - mu) ** 3) / nullif(sqrt(avg((x - mu) ** 2)) ** 3, 0), 0) AS skewness,
         coalesce(avg((x - mu) ** 4) / nullif(avg((x - mu) ** 2) ** 2, 0) - 3, 0) AS kurtosis, sum(x * x) AS energy, avg(x * x) AS power
  FROM m GROUP BY 1, 2),
h AS (SELECT channel, k, least(19, trunc((x - lo) / (hi - lo) * 19))::INT AS bin, count(*) AS c FROM m WHERE hi > lo GROUP BY 1, 2, 3),
ent AS (SELECT channel, k, -sum(c / 64.0 * log2(c / 64.0)) AS entropy FROM h GROUP BY 1, 2),
sf AS (SELECT mom.*, coalesce(entropy, 0) AS entropy FROM mom LEFT JOIN ent USING (channel, k))"""


#: All pairs of templates; the parsing one bit at a time: ``low`` is where the phrase begins, ``upto`` the last bit read.
COMPLEXITY = """t AS MATERIALIZED (
  SELECT channel, k, j, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c, 0.2 * stddev_pop(x) OVER (PARTITION BY channel, k) AS r FROM full_w WINDOW v AS (PARTITION BY channel, k ORDER BY j)),
pr AS (SELECT s.channel, s.k, s.j AS i, t.j, s.c IS NOT NULL AND t.c IS NOT NULL AS prolonged, abs(s.c - t.c) <= s.r AS three FROM t s JOIN t USING (channel, k) WHERE s.b IS NOT NULL AND t.b IS NOT NULL AND abs(s.a - t.a) <= s.r AND abs(s.b - t.b) <= s.r),
near AS (SELECT channel, k, i, count(*) AS two, count(*) FILTER (prolonged) AS going, count(*) FILTER (prolonged AND three) AS three FROM pr GROUP BY 1, 2, 3),
en AS (
  SELECT channel, k, CASE WHEN sum(three) FILTER (three > 0) > 62 AND sum(going) > 62 THEN ln((sum(going) - 62) / (sum(three) - 62)) END AS sample_entropy,
         avg(ln(two / 63.0)) - avg(ln(three / 62.0)) FILTER (three > 0) AS approximate_entropy
  FROM near GROUP BY 1, 2),
bits AS (SELECT channel, k, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY j) AS s FROM (SELECT *, median(x) OVER (PARTITION BY channel, k) AS m FROM full_w) GROUP BY 1, 2),
lz(channel, k, s, upto, low, n) AS (
  SELECT channel, k, s, 0, 1, 0 FROM bits
  UNION ALL
  SELECT channel, k, s, upto + 1, CASE WHEN old THEN low ELSE upto + 2 END, CASE WHEN old THEN n ELSE n + 1 END
  FROM (SELECT *, contains(left(s, upto), s[low:upto + 1]) AS old FROM lz WHERE upto < 64)),
cx AS (SELECT channel, k, sample_entropy, approximate_entropy, (n + CASE WHEN low <= 64 THEN 1 ELSE 0 END) * log2(64) / 64 AS lempel_ziv FROM lz JOIN en USING (channel, k) WHERE upto = 64)"""


def spectra(source: str, keys: str) -> list[str]:
    """Power of bins 0 to 31 of 64-sample windows by the definition of the transform, and features of them. Bands: Low 10-60, Mid 60-150, High 150-300 Hz."""
    return [
        f"""sp AS MATERIALIZED (
  SELECT {keys}, bin::INT AS bin, bin * 1000.0 / 64 AS f, power(sum(x * cos(2 * pi() * bin * j / 64)), 2) + power(sum(x * sin(2 * pi() * bin * j / 64)), 2) AS p
  FROM {source}, range(32) b(bin) GROUP BY {keys}, bin),
tot AS (SELECT {keys}, sum(p) AS total, sum(f * p) / sum(p) AS c FROM sp GROUP BY {keys}),
cum AS (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY bin) AS heap FROM sp JOIN tot USING ({keys})),
qf AS (
  SELECT {keys}, max(total) AS total_power, max(c) AS spectral_centroid, sqrt(sum((f - c) ** 2 * p / total)) AS spectral_spread,
         sum(f * p) FILTER (bin > 0) / sum(p) FILTER (bin > 0) AS mean_frequency, min(f) FILTER (heap >= total / 2) AS median_frequency,
         min(f) FILTER (heap >= 0.95 * total) AS spectral_edge_95, max_by(f, {{'p': p, 'b': bin}}) AS peak_frequency, sqrt(max(p)) AS peak_magnitude,
         -sum(CASE WHEN p > 0 THEN p / total * log2(p / total) ELSE 0 END) AS spectral_entropy,
         sum(p) FILTER (bin BETWEEN 0 AND 3) AS low, sum(p) FILTER (bin BETWEEN 3 AND 9) AS mid, sum(p) FILTER (bin BETWEEN 9 AND 19) AS high
  FROM cum GROUP BY {keys})"""
    ]


def rounded(names, digits=q.LARGE) -> str:
    return ", ".join(r(n, n, digits.get(n, 4)) for n in names)


SHAPE = f"channel, k, k * {q.SIZE // 2} AS start_sample, k * {q.SIZE // 2} + {q.SIZE} AS end_sample, {q.SIZE}::BIGINT AS window_size, 1000.0::DOUBLE AS sampling_rate"
TIME_NAMES = ["mean", "rms", "mav", "waveform_length", "variance", "std_dev", "min_value", "max_value", "peak_to_peak"]
SPECTRAL_NAMES = [
    "mean_frequency",
    "median_frequency",
    "peak_frequency",
    "spectral_centroid",
    "spectral_spread",
    "spectral_entropy",
    "total_power",
    "peak_magnitude"
]


def activation(p: Pattern, t: str) -> str:
    v = {k: repr(float(x)) for k, x in p.params}
    return {
        "constant": "{level}",
        "sinusoidal": "{baseline} + {amplitude} * sin(2 * pi() * {frequency} * {t})",
        "ramp": "CASE WHEN {t} >= {duration} THEN {end_level} ELSE {start_level} + ({end_level} - {start_level}) * {t} / {duration} END",
        "burst": "CASE WHEN {t} % ({on_time} + {off_time}) < {on_time} THEN {amplitude} ELSE 0.0 END",
        "fatigue": "{initial_level} * exp(-{decay_rate} * {t})",
        "realistic": "greatest(0.0, least(1.0, {base_level} + {tremor_amplitude} * sin(2 * pi() * {tremor_frequency} * {t})))",
    }[p.kind].format(t=f"({t})", **v)


def emg(powerline: bool) -> str:
    line = " + 0.05 * sin(2 * pi() * 50.0 * t)" if powerline else ""
    return f"""WITH s AS (SELECT channel::INT AS channel, i::BIGINT AS idx, i / 1000.0::DOUBLE AS t FROM range(2000) a(i), range(4) b(channel)),
p AS (SELECT *, 2 * pi() * (80 + 10 * channel) * t AS w, {activation(q.CLEAN.pattern, "t")} AS a FROM s)
SELECT channel, idx, {r("t", "t")}, {r(f"greatest(-5.0, least(5.0, 2.0 * a * (sin(w) + 0.3 * sin(2 * w) + 0.1 * sin(3 * w)){line}))", "x")} FROM p"""


def literal_rows(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + str(v) + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, row)) + ')' for row in rows)}) AS v({names})"


def config(known) -> list[str]:
    processors = [
        (p.name, n, "features" if x.kind == "features" else "filter", x.params.get("order"), x.params.get("size")) for p in known for n,
        x in p.processors.items()
    ]
    chains = [(p.name, c, i, n) for p in known for c, chain in p.pipelines.items() for i, n in enumerate(chain.processors)]
    return [
        f"pr AS (SELECT * FROM {literal_rows(processors, 'profile, processor, kind, ord, size')})",
        f"ch AS (SELECT * FROM {literal_rows(chains, 'profile, pipeline, position, processor')})"
    ]


def plain(select: str) -> str:
    return with_([SAMPLES], select)


def of_sections(sections, select: str = "") -> str:
    ctes, last = recursion(sections)
    return with_([SAMPLES, *ctes], select.format(last=last) or f"SELECT channel, idx, {r('x', 'y')} FROM {last}")


def oracle_sql() -> dict[str, str]:
    dft = [
        "full_v AS (SELECT vec_id AS k, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)",
        *spectra("full_v", "k")
    ]
    first = with_([SAMPLES, *windowed("samples")], "{}")
    realtime, last = recursion(q.PIPELINES["pipeline_realtime"].sections(q.RATE))
    out = {
        "deinterleave": f"SELECT (i % 4)::INT AS channel, chunk_seq * 16 + i // 4 AS idx, {r('x', 'x')} FROM (SELECT vec_id AS chunk_seq, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        "reinterleave": f"SELECT vec_id AS chunk_seq, 4 AS channel_count, 64::BIGINT AS n, {r('embedding[6]::DOUBLE', 'sixth')}, {r('w', 'weighted')} FROM embeddings JOIN (SELECT vec_id, sum(x * (i + 1)) AS w FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1) USING (vec_id)",
        "channel_stats": plain(
            f"SELECT channel, count(*) AS n, {r('avg(x)', 'mean')}, {r('sqrt(avg(x * x))', 'rms')}, {r('stddev_pop(x)', 'std_dev')}, {r('min(x)', 'min_value')}, {r('max(x)', 'max_value')}, {r('max(x) - min(x)', 'peak_to_peak')} FROM samples GROUP BY 1"
        ),
        "time_slice": plain(
            f"SELECT channel, idx - 100 AS idx, {r('(idx - 100) / 1000.0::DOUBLE', 't')}, {r('x', 'x')} FROM samples WHERE idx >= 100 AND idx < 350"
        ),
        "time_vector": plain(f"SELECT channel, idx, {r('idx / 1000.0::DOUBLE', 't')} FROM samples"),
        "recent_window": plain(
            f"SELECT channel, idx, {r('x', 'x')} FROM samples WHERE idx / 1000.0::DOUBLE >= (SELECT max(idx) / 1000.0::DOUBLE FROM samples) - 3.0::DOUBLE"
        ),
        "plot_columns": plain(f"SELECT idx, {', '.join(r(f'max(x) FILTER (channel = {c})', f'ch{c}') for c in range(16))} FROM samples GROUP BY 1"),
        "raw_vs_processed": of_sections(
            q.SECTIONS["highpass_20"],
            f"SELECT channel, idx, {r('s.x', 'x_raw')}, {r('f.x', 'x')} FROM samples s JOIN {{last}} f USING (channel, idx)"
        ),
        "sliding_windows_64": first.format(
            f"SELECT channel, k, k * 32 AS start_sample, count(*) AS n, {r('sum(x)', 'sum')}, {r('max(x) FILTER (j = 0)', 'first')}, {r('max(x) FILTER (j = 63)', 'last')} FROM full_w GROUP BY 1, 2"
        ),
        "time_features": with_(
            [SAMPLES, *windowed("samples"), TIME],
            f"SELECT {SHAPE}, zero_crossings, slope_sign_changes, {rounded(TIME_NAMES, q.EXACT)} FROM tf"
        ),
        "stat_features": with_(
            [SAMPLES, *windowed("samples"), STATISTICS],
            f"SELECT {SHAPE}, {rounded(['skewness', 'kurtosis', 'entropy', 'energy', 'power'], q.EXACT)} FROM sf"
        ),
        "complexity_features": with_([SAMPLES, *windowed("samples"), COMPLEXITY], f"SELECT channel, k, {rounded(q.complexity.NAMES, dict.fromkeys(q.complexity.NAMES, 6))} FROM cx"),
        # The Hilbert transformer as a sum over its taps, 32 to both sides.
        "instantaneous_frequency": with_(
            [
                SAMPLES,
                "taps AS (SELECT k, CASE WHEN k % 2 <> 0 THEN 2 / (pi() * k) * (0.54 + 0.46 * cos(pi() * k / 32)) ELSE 0 END AS h FROM range(-32, 33) r(k))",
                "hs AS (SELECT s.channel, s.idx, any_value(s.x) AS x, coalesce(sum(h * e.x), 0) AS h FROM samples s, taps LEFT JOIN samples e ON e.channel = s.channel AND e.idx = s.idx - k GROUP BY 1, 2)",
                "z AS (SELECT *, lag(x) OVER v AS x1, lag(h) OVER v AS h1 FROM hs WINDOW v AS (PARTITION BY channel ORDER BY idx))",
            ],
            f"SELECT channel, idx, {r('sqrt(x * x + h * h)', 'amplitude')}, {r('atan2(h * x1 - x * h1, x * x1 + h * h1) * 1000.0::DOUBLE / (2 * pi())', 'frequency')} FROM z",
        ),
        "spectrum_64": with_(dft, f"SELECT k, bin, {r('f', 'freq')}, {r('p', 'p')} FROM sp"),
        "spectral_features": with_(dft, f"SELECT k, {rounded([*SPECTRAL_NAMES, 'spectral_edge_95'], {})} FROM qf"),
        "band_powers": with_(
            [SAMPLES, *windowed("samples"), *spectra("full_w", "channel, k")],
            f"SELECT channel, k, {rounded(['low', 'mid', 'high'])} FROM qf"
        ),
        "bands_out_of_range": with_(
            [SAMPLES, *windowed("samples"), *spectra("full_w", "channel, k")],
            f"SELECT channel, k, {r('sum(p) FILTER (bin >= 28)', 'top', 0)}, 0.0::DOUBLE AS beyond FROM sp GROUP BY channel, k"
        ),
        "feature_summary": with_(
            [SAMPLES, *windowed("samples"), TIME, *spectra("full_w", "channel, k")],
            f"SELECT channel, k, 64::BIGINT AS window_size, zero_crossings, {rounded(['rms', 'mav', 'mean_frequency', 'spectral_centroid', 'total_power'], q.LARGE | q.EXACT)} FROM tf JOIN qf USING (channel, k)"
        ),
        "emg_features": with_(
            [SAMPLES, *realtime, *windowed(last), TIME, STATISTICS, *spectra("full_w", "channel, k")],
            f"SELECT {SHAPE}, zero_crossings, slope_sign_changes, {rounded([*TIME_NAMES, *SPECTRAL_NAMES, 'low', 'mid', 'high', 'skewness', 'kurtosis', 'entropy', 'energy', 'power'])} FROM tf JOIN qf USING (channel, k) JOIN sf USING (channel, k)",
        ),
        "pattern_presets": "\nUNION ALL ".join(
            f"SELECT '{n}' AS name, '{p.kind}' AS kind, '{KINDS[p.kind][0]}' AS description, {r('greatest(0.0, least(1.0, avg(' + activation(p, 'i * 10.0 / 100') + ')))', 'mean_activation')} FROM range(100) a(i)" for n, p in PRESETS.items()
        ),
        "activation_patterns": "\nUNION ALL ".join(
            f"SELECT {r('t', 't')}, '{n}' AS name, {r('(' + activation(p, 't') + ')::DOUBLE', 'activation')} FROM (SELECT i / 10.0::DOUBLE + 0.05::DOUBLE AS t FROM range(200) a(i))" for n,
            p in PRESETS.items()
        ),
        "simulate_clean": emg(False),
        "simulate_powerline": emg(True),
        "simulate_metadata": f"SELECT 'emg' AS signal_id, 'surface' AS kind, 'Biceps' AS muscle_group, {r('avg(' + activation(q.CLEAN.pattern, 'i * 2.0 / 100') + ')', 'activation_level')}, 1000.0::DOUBLE AS sampling_rate, 4 AS channel_count, 2.0::DOUBLE AS duration, 0.0::DOUBLE AS noise_level, 8000::BIGINT AS expected_samples FROM range(100) a(i)",
        "chunk_stats": plain(
            f"SELECT idx // 100 AS chunk_seq, count(DISTINCT channel) AS channels, count(*) AS samples, {r('avg(x)', 'mean', 8)}, {r('sqrt(avg(x * x))', 'rms')} FROM samples GROUP BY 1"
        ),
        "buffer_stats": plain(
            f"SELECT count(DISTINCT idx // 100) AS chunks, count(*) AS samples, {r('count(DISTINCT idx) / 1000.0::DOUBLE', 'duration')} FROM samples"
        ),
        "chunk_start_times": plain(
            f"SELECT idx // 100 AS chunk_seq, {r('count(DISTINCT idx) / 1000.0::DOUBLE', 'duration')}, {r('min(idx) / 1000.0::DOUBLE', 'start_time')} FROM samples GROUP BY 1"
        ),
        "processing_stats": plain("SELECT count(DISTINCT idx // 100) AS chunks, count(*) AS samples, 1.0::DOUBLE AS success_rate FROM samples"),
        "signal_lengths": plain(
            f"SELECT count(*) AS channels, sum(n)::BIGINT AS samples, max(n) AS samples_per_channel, {r('max(n) / 1000.0::DOUBLE', 'duration')} FROM (SELECT channel, count(*) AS n FROM samples GROUP BY 1)"
        ),
        "sample_violations": "SELECT (user_id % 20)::INT AS channel, count(*) AS n, count(DISTINCT event_id) AS distinct, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1 HAVING NOT (count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AND (any_value(user_id) % 20) BETWEEN 0 AND 15)",
        "latest_chunk": plain(f"SELECT channel, idx, {r('x', 'x')} FROM samples WHERE idx // 100 = (SELECT max(idx) // 100 FROM samples)"),
        "buffer_tail": plain(f"SELECT channel, idx, {r('x', 'x')} FROM samples WHERE idx // 100 > (SELECT max(idx) // 100 FROM samples) - 100"),
        "plot_tail": plain(f"SELECT channel, idx, {r('x', 'x')} FROM samples QUALIFY row_number() OVER (PARTITION BY channel ORDER BY idx DESC) <= 3000"),
        "config_latency": with_(
            config([p() for n, p in profiles.PROFILES.items() if n != "custom"]),
            f"SELECT profile, pipeline, {r('sum(CASE kind WHEN $$filter$$ THEN coalesce(ord, 2) * 0.1::DOUBLE ELSE coalesce(size, 256) / 1000.0::DOUBLE END)', 'latency')}, count(*) AS stages FROM ch JOIN pr USING (profile, processor) GROUP BY 1, 2"
        ),
        "config_unknown_processors": with_(
            config([profiles.realtime().chain("broken", ["rt_highpass", "missing"]), profiles.research()]),
            "SELECT profile, pipeline, position, processor FROM ch ANTI JOIN pr USING (profile, processor)"
        ),
    }
    out |= {
        f"moving_average_{n}": plain(
            f"SELECT channel, idx, {r(f'avg(x) OVER (PARTITION BY channel ORDER BY idx ROWS {n - 1} PRECEDING)', 'y', 6)} FROM samples"
        ) for n in (3, 10)
    }
    out["moving_average_1000"] = plain(f"SELECT channel, idx, {r('avg(sqrt(abs(x))) OVER (PARTITION BY channel ORDER BY idx ROWS 999 PRECEDING)', 'y', 6)} FROM samples")
    out |= {f"median_filter_{n}": plain(f"SELECT channel, idx, {r(f'median(x) OVER (PARTITION BY channel ORDER BY idx ROWS {n - 1} PRECEDING)', 'y')} FROM samples") for n in (5, 101)}
    out |= {n: of_sections(DESIGNS.get(n, s)) for n, s in q.SECTIONS.items()}
    both = f"SELECT channel, idx, {r('s.x', 'x_raw')}, {r('f.x', 'y')} FROM samples s JOIN {{last}} f USING (channel, idx)"
    out |= {n: of_sections(p.sections(q.RATE), both) for n, p in q.PIPELINES.items() if n not in ("pipeline_profile_realtime", "pipeline_fallback")}
    out["pipeline_fallback"] = plain(f"SELECT channel, idx, {r('x', 'x_raw')}, {r('avg(x) OVER (PARTITION BY channel ORDER BY idx ROWS 3 PRECEDING)', 'y')} FROM samples")
    smooth = f"sm AS (SELECT channel, idx, avg(x) OVER (PARTITION BY channel ORDER BY idx ROWS 2 PRECEDING) AS x FROM {last})"
    out["pipeline_profile_realtime"] = with_([SAMPLES, *realtime, smooth], both.format(last="sm"))
    out["stream_filter_equals_batch"] = out["pipeline_realtime"]
    out["stream_pipeline_equals_batch"] = out["stream_state_equals_batch"] = out["pipeline_profile_realtime"]
    figures = ", ".join([r("avg(value)", "mean"), r("sqrt(avg(value * value))", "rms"), r("min(value)", "min_value"), r("max(value)", "max_value")])
    out["session_features"] = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS g FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS new FROM e))
SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n, {figures} FROM g GROUP BY user_id, g"""
    out["tumbling_features"] = f"""WITH e AS (SELECT user_id, epoch_us(ts) // 21600000000 AS w, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, w * 21600000000 AS start_us, (w + 1) * 21600000000 AS end_us, count(*) AS n, {figures} FROM e GROUP BY user_id, w"""
    out["chunk_file_slice"] = f"""SELECT (i % 4)::INT AS channel, vec_id * 16 + i // 4 AS idx, {r('(vec_id * 16 + i // 4) / 1000.0::DOUBLE', 't')}, {r('x', 'x')}
FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE vec_id * 16 + i // 4 BETWEEN 125 AND 524"""
    out["paired_streams"] = f"""SELECT (user_id % 16)::INT AS channel, event_id AS idx, {r('value', 'x_raw')}, {r('CASE WHEN event_id % 7 <> 3 THEN greatest(20.0, least(60.0, value))::DOUBLE END', 'x')}, event_id % 7 <> 3 AS success
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"""
    gapped = "gapped AS MATERIALIZED (SELECT channel, idx AS place, row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS idx, x FROM samples WHERE idx >= 40 AND idx % 7 <> 3)"
    late, end = recursion(q.SECTIONS["highpass_20"], "gapped", "g")
    out["highpass_with_gaps"] = with_([SAMPLES, gapped, *late], f"SELECT channel, place AS idx, {r('f.x', 'y')} FROM {end} f JOIN gapped USING (channel, idx)")
    out["one_channel"] = plain(f"SELECT channel, idx, {r('x', 'x')} FROM samples WHERE channel = 3")
    out["clamped"] = plain(f"SELECT channel, idx, {r('greatest(20.0, least(60.0, x))::DOUBLE', 'x')} FROM samples")
    none = ", ".join(f"0.0::DOUBLE AS {n}" for n in ("variance", "waveform_length", *q.features.STATISTICS))
    out["windows_of_one"] = plain(
        f"SELECT channel, idx AS k, idx AS start_sample, idx + 1 AS end_sample, 1::BIGINT AS window_size, 1000.0::DOUBLE AS sampling_rate, 0::BIGINT AS zero_crossings, {r('x', 'mean')}, {none} FROM samples"
    )
    out["signal_quality"] = plain(
        f"SELECT channel, count(*) AS n, {r('CASE WHEN channel = 2 THEN least(30, count(*)) / count(*) ELSE 1.0::DOUBLE END', 'quality')} FROM samples GROUP BY 1"
    )
    out["expected_samples"] = "SELECT vec_id AS chunk_seq, 68::BIGINT AS expected, 64::BIGINT AS actual, true AS channels_valid FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 10 = 0"
    high, end = recursion(q.SECTIONS["highpass_20"])
    smooth = f"sm AS (SELECT channel, idx, avg(abs(x)) OVER (PARTITION BY channel ORDER BY idx ROWS 9 PRECEDING) AS x FROM {end})"
    out["pipeline_with_own_stage"] = with_([SAMPLES, *high, smooth], both.format(last="sm"))
    return out
