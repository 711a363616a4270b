"""DuckDB SQL for the catalogue, written apart from the Spark plans: bytes are pairs of hex digits there."""

from __future__ import annotations

from bytemill.schema import CODECS, ENTROPY, HEX, LEAST_RUN, NOT_SEARCHED, OVERSIZE, PRINTABLE, WINDOW

_KEYS = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id || '/' || turn", "text"), "benchmark": ("item_id", "text")}


def src(name: str = "documents", cte: str = "src") -> str:
    key, text = _KEYS[name]
    return f"{cte} AS MATERIALIZED (SELECT '{name}/' || {key} AS path, hex(encode(coalesce({text}, ''))) AS h FROM {name})"


def chunks(size: int = 4096, source: str = "src", cte: str = "chunks") -> str:
    return f"{cte} AS MATERIALIZED (SELECT path, (o // {2 * size})::INT AS chunk_idx, (o // 2)::BIGINT AS \"offset\", substr(h, (o + 1)::INT, {2 * size}) AS c FROM {source}, unnest(range(0, length(h), {2 * size})) AS t(o))"


#: A list of numbers is made of each string before it is unnested: rows with a number each must not carry the string.
_VALUES = "unnest(list_transform(range(0, length(c) // 2), lambda i: ('0x' || substr(c, (2 * i + 1)::INT, 2))::UTINYINT))"
COUNTS = f"""bytes AS (SELECT path, chunk_idx, {_VALUES} AS v FROM chunks),
counts AS MATERIALIZED (SELECT path, chunk_idx, v::INT AS v, count(*) AS n FROM bytes GROUP BY ALL)"""
_PRINTABLE = "sum(CASE WHEN v IN (9, 10, 13) OR v BETWEEN 32 AND 126 THEN n ELSE 0 END) / sum(n)"
_HEX = "sum(CASE WHEN v BETWEEN 48 AND 57 OR v BETWEEN 65 AND 70 OR v BETWEEN 97 AND 102 THEN n ELSE 0 END) / sum(n)"
_ENTROPY = "(log2(sum(n)) - sum(n * log2(n)) / sum(n))"
_MEAN = "(sum(v::BIGINT * n)::DOUBLE / sum(n)::DOUBLE)"
_VARIANCE = "((sum(n) * sum(v::BIGINT * v * n) - sum(v::BIGINT * n) * sum(v::BIGINT * n))::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE))"


def six(expression: str) -> str:
    return f"floor(({expression})::DOUBLE * 1e6 + 0.5) / 1e6"


def on_counts(select: str) -> str:
    return f"WITH {src()}, {chunks()}, {COUNTS} SELECT path, chunk_idx, {select} FROM counts GROUP BY path, chunk_idx"


def windows(source: str = "src", cte: str = "win") -> str:
    return f"""{chunks(WINDOW, source, f"{cte}_c")},
    {cte}_b AS (SELECT path, chunk_idx, {_VALUES} AS v FROM {cte}_c),
    {cte}_n AS (SELECT path, chunk_idx, v::INT AS v, count(*) AS n FROM {cte}_b GROUP BY ALL),
    {cte} AS MATERIALIZED (SELECT path, chunk_idx AS win_idx, ({_PRINTABLE} >= {PRINTABLE} AND {_ENTROPY} < {ENTROPY} AND {_HEX} < {HEX}) AS is_text FROM {cte}_n GROUP BY path, chunk_idx)"""


def runs(source: str = "src", cte: str = "win") -> str:
    """Boundary lists: raw and merged, for each path with bytes."""
    return f"""{windows(source, cte)},
    {cte}_cut AS (SELECT path, win_idx * {WINDOW} AS b FROM (SELECT *, lag(is_text) OVER (PARTITION BY path ORDER BY win_idx) AS was FROM {cte}) WHERE was <> is_text),
    {cte}_raw AS MATERIALIZED (SELECT s.path, s.h, list_sort(coalesce(list(b) FILTER (b IS NOT NULL), [])) AS inner_b, length(s.h) // 2 AS n FROM {source} s LEFT JOIN {cte}_cut c ON s.path = c.path WHERE length(s.h) > 0 GROUP BY s.path, s.h),
    {cte}_merged AS MATERIALIZED (SELECT path, h, list_append(list_reduce(list_transform(inner_b, lambda x: [x::BIGINT]), lambda a, x: CASE WHEN x[1] - a[-1] < {LEAST_RUN} THEN a ELSE list_concat(a, x) END, [0::BIGINT]), n::BIGINT) AS b FROM {cte}_raw),
    {cte}_run AS MATERIALIZED (SELECT path, h, (i - 1)::INT AS chunk_idx, b[i] AS "offset", b[i + 1] - b[i] AS length FROM {cte}_merged, unnest(range(1, len(b))) AS t(i))"""


def comparison() -> str:
    parts, ctes = [], []
    for i, name in enumerate(("documents", "pages")):
        ctes += [src(name, f"s{i}"), chunks(4096, f"s{i}", f"f{i}"), runs(f"s{i}", f"w{i}")]
        for chunker, rows in (("fixed_size", f"(SELECT length(c) // 2 AS length FROM f{i})"), ("content_aware", f"w{i}_run")):
            parts.append(f"SELECT '{name}' AS corpus, '{chunker}' AS chunker, count(*) AS chunks, {six("avg(length)")} AS avg_length, min(length)::BIGINT AS min_length, max(length)::BIGINT AS max_length FROM {rows}")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(parts)


def longest() -> str:
    ctes = ", ".join(f"{src(n, f's{i}')}, {runs(f's{i}', f'w{i}')}" for i, n in enumerate(_KEYS))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS corpus, path, chunk_idx, length::BIGINT AS length FROM w{i}_run" for i, n in enumerate(_KEYS))
    return f"WITH {ctes} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY length DESC, path, chunk_idx)::INT AS rank FROM ({rows})) WHERE rank <= 10"


SPLIT = """n AS (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY sha256('0:' || doc_id), doc_id) AS r FROM labels),
t AS (SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0)::INT) AS a, greatest(1, round_even(n * 0.15::DOUBLE, 0)::INT) AS z FROM n),
u AS (SELECT *, greatest(0, a + z - n + 1) AS over FROM t),
w AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, a - over) END AS v, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(1, z - (over - (a - greatest(1, a - over)))) END AS s FROM u),
split AS (SELECT doc_id, quality AS label, CASE WHEN r <= n - s - v THEN 'train' WHEN r <= n - s THEN 'val' ELSE 'test' END AS split FROM w)"""
MATRIX = """l AS (SELECT quality AS l FROM labels UNION SELECT toxic FROM labels),
m AS (SELECT a.l AS y, b.l AS y_hat, (SELECT count(*) FROM labels WHERE quality = a.l AND toxic = b.l) AS n FROM l a, l b)"""
REPORT = f"""WITH {MATRIX},
e AS (SELECT y::VARCHAR AS label, sum(CASE WHEN y = y_hat THEN n ELSE 0 END) AS hit, sum(n) AS support, (SELECT sum(n) FROM m k WHERE k.y_hat = m.y) AS said FROM m GROUP BY y),
p AS (SELECT label, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support FROM e),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p),
a AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT label, {six('precision')} AS precision, {six('recall')} AS recall, {six('f1')} AS f1, support::BIGINT AS support FROM a"""


def registry(where: str = "") -> str:
    rows = ", ".join(f"({i}, '{c}', {str(c not in NOT_SEARCHED).lower()})" for i, c in enumerate(CODECS))
    return f"SELECT * FROM (VALUES {rows}) t(algorithm_id, name, in_default_search){where}"


def layout(entry: int) -> str:
    start = f"(49 + {entry} * ((length(h) // 2 + 4095) // 4096))"
    return f"""WITH {src()}, {chunks()} SELECT path, chunk_idx, "offset" AS payload_offset, 49::BIGINT AS table_offset, {start}::BIGINT AS payload_start, ({start} + length(h) // 2)::BIGINT AS archive_size FROM chunks JOIN src USING (path)"""


RESTORED = f"WITH {src()} SELECT path, (length(h) // 2)::BIGINT AS restored_length, sha256(from_hex(h)) AS restored_sha256 FROM src"
ROUND_TRIP = f"WITH {src()}, {chunks()} SELECT path, chunk_idx, sha256(from_hex(c)) AS sha256, '%s' AS magic FROM chunks"
RECORDS = f"""WITH {src()}, {chunks()} SELECT path, chunk_idx, "offset", (length(c) // 2)::BIGINT AS length, 'store' AS algorithm, sha256(from_hex(c)) AS checksum FROM chunks"""
_N = "split_part(path, '/', 2)::BIGINT % 10"
VIOLATIONS = f"""WITH {src()}, {chunks()},
  first AS (SELECT s.path, h, (length(h) // 2)::BIGINT AS n, (length(c) // 2)::BIGINT AS l, sha256(from_hex(c)) AS sum, split_part(s.path, '/', 2)::BIGINT % 10 AS k FROM src s JOIN chunks f ON f.path = s.path AND chunk_idx = 0),
  found AS (
  SELECT path, NULL::INT AS chunk_idx, 'source_size' AS "check", (length(h) // 2 + 1)::VARCHAR AS expected, (length(h) // 2)::VARCHAR AS actual FROM src WHERE {_N} = 1
  UNION ALL SELECT path, 0, 'checksum', '00', sum FROM first WHERE k = 2
  UNION ALL SELECT path, 0, 'contiguity', '0', '1' FROM first WHERE k = 3
  UNION ALL SELECT path, 1, 'contiguity', (1 + l)::VARCHAR, l::VARCHAR FROM first WHERE k = 3 AND n > l
  UNION ALL SELECT path, 0, 'checksum', sum, sha256(from_hex(substr(h, 3, (2 * l)::INT))) FROM first WHERE k = 3
  UNION ALL SELECT path, NULL, 'coverage', n::VARCHAR, (n + 1)::VARCHAR FROM first WHERE k = 3 AND n = l
  UNION ALL SELECT path, 0, 'algorithm', 'a known codec', 'rar' FROM first WHERE k = 4)
SELECT * FROM found WHERE expected <> actual"""
#: What each codec's output begins with, fixed values of the formats.
MAGIC = {"store": "", "gzip": "1f8b", "bzip2": "425a68", "lzma": "fd377a585a00", "zstd": "28b52ffd"}
#: Sizes of fixed contents: name, then store, gzip, bzip2, lzma, zstd, and the winner of a search (the smaller id of equals); fixed values at the codecs' default levels.
KNOWN = {
    "empty": (0, 20, 14, 32, 9, "store"),
    "seventeen letters": (17, 23, 39, 68, 17, "store"),
    "forty letters": (40, 25, 40, 68, 17, "zstd"),
    "line": (44, 63, 80, 100, 53, "store"),
    "zeros": (4096, 38, 43, 92, 19, "zstd"),
    "pangrams": (3960, 88, 137, 136, 63, "zstd"),
    "noise": (4096, 4119, 4596, 4156, 4106, "store"),
    "hex": (8192, 4738, 4255, 4420, 4272, "bzip2"),
    "squares": (76374, 33860, 30209, 19564, 33226, "lzma"),
}
#: Sizes that are made up from length and document number, ties among them, and a choice for each document.
GIVEN = """given AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
  sized AS (SELECT *, n AS store, n // 2 + 20 AS gzip, n // 3 + 40 * (doc_id % 3) AS bzip2, n // 3 + 60 AS lzma, n // 2 + 20 - doc_id % 2 AS zstd, doc_id % 5 AS pick FROM given),
  judged AS (SELECT *, least(store, bzip2, lzma, zstd) AS best, CASE pick WHEN 0 THEN store WHEN 1 THEN gzip WHEN 2 THEN bzip2 WHEN 3 THEN lzma ELSE zstd END AS picked FROM sized)"""
_CASES = {
    "sound": "", "trailing_bytes": "", "magic": "E", "empty": "E", "short_header": "E", "short_table": "E", "short_payload": "E", "unknown_codec": "E", "source_size": "E", "source_checksum": "E", "chunk_length": "E",
}
CORRUPTION = "SELECT * FROM (VALUES " + ", ".join(
    f"('{name}/{case}', '{error if bad else 'none'}')" for name, error, extra in (("plain", "ArchiveError", {}), ("checked", "DecodeError", {"chunk_checksum": "E"})) for case, bad in (_CASES | extra).items()) + ') t("case", error)'


def sizes_text(n: str) -> str:
    scaled = " ".join(f"WHEN {n} < {1024 ** (k + 1)} THEN printf('%.1f', {n} / {1024 ** k}.0) || ' {u}'" for k, u in ((1, "KB"), (2, "MB"), (3, "GB")))
    return f"CASE WHEN {n} < 1024 THEN format('{{:,}}', {n}) || ' B' {scaled} ELSE printf('%.1f', {n} / {1024 ** 4}.0) || ' TB' END"


def oracle() -> dict[str, str]:
    pair = f"""pairs AS (SELECT path, chunk_idx, unnest(list_transform(range(0, length(c) // 2 - 1), lambda i: ('0x' || substr(c, (2 * i + 1)::INT, 4))::USMALLINT)) AS p FROM chunks),
      pc AS MATERIALIZED (SELECT path, chunk_idx, p, count(*) AS n FROM pairs GROUP BY ALL),
      cl AS MATERIALIZED (SELECT path, chunk_idx, length(c) // 2 AS size FROM chunks),
      pr AS MATERIALIZED (SELECT * FROM (SELECT path, chunk_idx, n, row_number() OVER (PARTITION BY path, chunk_idx ORDER BY n DESC) - 1 AS rank FROM pc) WHERE rank < 10),
      top AS MATERIALIZED (SELECT c.path, c.chunk_idx, k::INT AS rank, coalesce(pr.n / (c.size - 1), 0) AS freq FROM cl c CROSS JOIN unnest(range(0, 10)) AS t(k) LEFT JOIN pr ON pr.path = c.path AND pr.chunk_idx = c.chunk_idx AND pr.rank = k)"""
    described = 'path, chunk_idx, "offset", (length(c) // 2)::BIGINT AS length, sha256(from_hex(c)) AS sha256'
    out = {
        "source_scan": f"WITH {src()} SELECT path, (length(h) // 2)::BIGINT AS length, sha256(from_hex(h)) AS sha256 FROM src",
        "source_scan_union": " UNION ALL ".join(f"SELECT '{n}' AS corpus, count(*) AS files, sum(octet_length(encode(coalesce({t}, ''))))::BIGINT AS bytes FROM {n}" for n, (_, t) in _KEYS.items()),
        **{f"chunk_fixed_{n}": f"WITH {src()}, {chunks(n)} SELECT {described} FROM chunks" for n in (4096, 16384, 777)},
        "byte_counts": f"WITH {src()}, {chunks()}, {COUNTS} SELECT path, chunk_idx, v AS byte, n FROM counts",
        "byte_histogram": f"WITH {src()}, {chunks()}, {COUNTS} SELECT path, chunk_idx, v AS byte, {six('n / sum(n) OVER (PARTITION BY path, chunk_idx)')} AS freq FROM counts",
        "entropy": on_counts(f"{six(_ENTROPY)} AS value"), "printable_ratio": on_counts(f"{six(_PRINTABLE)} AS value"), "printable_ratio_native": on_counts(f"{six(_PRINTABLE)} AS value"), "hex_ratio": on_counts(f"{six(_HEX)} AS value"),
        "byte_mean_variance": on_counts(f"{six(_MEAN)} AS mean, {six(_VARIANCE)} AS variance"),
        "bigram_topk": f"WITH {src()}, {chunks()}, {pair} SELECT path, chunk_idx, rank, {six('freq')} AS freq FROM top",
        "feature_scalars": on_counts(f"sum(n)::BIGINT AS length, {six(_ENTROPY)} AS entropy, {six(_PRINTABLE)} AS printable_ratio, {six(_MEAN)} AS byte_mean, {six(_VARIANCE)} AS byte_variance"),
        "feature_vector": f"""WITH {src()}, {chunks()}, {COUNTS}, {pair},
          s AS (SELECT path, chunk_idx, sum(n)::DOUBLE AS length, {six(_ENTROPY)} AS entropy, {six(_MEAN)} AS hist_mean, {six("sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n))")} AS hist_squares FROM counts GROUP BY path, chunk_idx),
          b AS (SELECT path, chunk_idx, {six("sum(freq * (rank + 1))")} AS pair_sum FROM top GROUP BY path, chunk_idx)
          SELECT path, chunk_idx, 271::BIGINT AS n, length, entropy, hist_mean, hist_squares, pair_sum FROM s JOIN b USING (path, chunk_idx)""",
        "feature_wide": f"""WITH {src()}, {chunks()}, {COUNTS}, {pair},
          h AS (SELECT path, chunk_idx, sum(CASE WHEN v = 32 THEN n ELSE 0 END) / sum(n) AS a, sum(CASE WHEN v = 101 THEN n ELSE 0 END) / sum(n) AS b FROM counts GROUP BY ALL),
          g AS (SELECT path, chunk_idx, max(CASE WHEN rank = 0 THEN freq END) AS c, max(CASE WHEN rank = 9 THEN freq END) AS d FROM top GROUP BY ALL)
          SELECT path, chunk_idx, {six('a')} AS hist_32, {six('b')} AS hist_101, {six('c')} AS bigram_top0, {six('d')} AS bigram_top9 FROM h JOIN g USING (path, chunk_idx)""",
        "window_classify": f"WITH {src()}, {windows()} SELECT path, win_idx, is_text FROM win",
        "boundaries_raw": f'WITH {src()}, {runs()}, b AS (SELECT path, list_concat(list_concat([0::BIGINT], inner_b::BIGINT[]), [n::BIGINT]) AS b FROM win_raw) SELECT path, (i - 1)::INT AS idx, b[i] AS "offset" FROM b, unnest(range(1, len(b) + 1)) AS t(i)',
        "boundaries_merged": f'WITH {src()}, {runs()} SELECT path, (i - 1)::INT AS idx, b[i] AS "offset" FROM win_merged, unnest(range(1, len(b) + 1)) AS t(i)',
        "chunk_content_aware": f'WITH {src()}, {runs()} SELECT path, chunk_idx, "offset", length::BIGINT AS length, sha256(from_hex(substr(h, (2 * "offset" + 1)::INT, (2 * length)::INT))) AS sha256 FROM win_run',
        "chunker_comparison": comparison(),
        "oversized_chunks": f"WITH {src()}, {runs()} SELECT count(*) AS n, coalesce(max(length), 0)::BIGINT AS max_length FROM win_run WHERE length > {OVERSIZE}",
        "longest_chunks": longest(),
        "algorithm_registry": registry(), "default_search_set": f"SELECT algorithm_id, name FROM ({registry(' WHERE in_default_search')})",
        "label_known": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::BIGINT' for x in v[:5])}, '{v[5]}', {min(v[0], *v[2:5])}::BIGINT)" for k, v in KNOWN.items()) + ') t("name", size_store, size_gzip, size_bzip2, size_lzma, size_zstd, best_algorithm, best_size)',
        "label_given": f"WITH {GIVEN} SELECT doc_id, CASE best WHEN store THEN 'store' WHEN bzip2 THEN 'bzip2' WHEN lzma THEN 'lzma' ELSE 'zstd' END AS best_algorithm, best AS best_size FROM judged",
        "ratio_given": f"WITH {GIVEN} SELECT count(*) AS n, sum(n)::BIGINT AS original, {six('sum(n) / sum(picked)')} AS predicted, {six('sum(n) / sum(zstd)')} AS always_zstd, {six('sum(n) / sum(best)')} AS ceiling FROM judged",
        "strategies_given": f"""WITH {GIVEN}, flat AS (SELECT n, unnest([{{'name': 'always_store', 'size': store}}, {{'name': 'always_gzip', 'size': gzip}}, {{'name': 'always_zstd', 'size': zstd}}, {{'name': 'brute_force_ceiling', 'size': best}}, {{'name': 'model_predicted', 'size': picked}}]) AS r FROM judged),
          t AS (SELECT r.name AS name, sum(n)::BIGINT AS total_original, sum(r.size)::BIGINT AS total_compressed FROM flat GROUP BY r.name)
          SELECT *, {six('total_original / total_compressed')} AS ratio, {six("100 * (total_original / total_compressed) / max(CASE WHEN name = 'brute_force_ceiling' THEN total_original / total_compressed END) OVER ()")} AS percent_of_ceiling FROM t""",
        "codec_counts_given": f"WITH {GIVEN}, c AS (SELECT CASE best WHEN store THEN 'store' WHEN bzip2 THEN 'bzip2' WHEN lzma THEN 'lzma' ELSE 'zstd' END AS algorithm FROM judged) SELECT algorithm, count(*) AS chunk_count, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM c GROUP BY algorithm",
        **{f"codec_roundtrip_{c}": ROUND_TRIP % m for c, m in MAGIC.items()},
        "manifest_records": RECORDS,
        "manifest_json": f"WITH {src()} SELECT path, (length(h) // 2)::BIGINT AS source_size, sha256(from_hex(h)) AS source_sha256, ((length(h) // 2 + 4095) // 4096)::BIGINT AS chunks, 1 AS version FROM src",
        "manifest_violations": VIOLATIONS,
        "archive_layout_checked": layout(49), "archive_layout_plain": layout(17),
        "archive_header_bytes": f"WITH {src()} SELECT path, lower(hex(encode('SZE1')) || '01' || lpad(hex(length(h) // 2), 16, '0') || sha256(from_hex(h)) || lpad(hex((length(h) // 2 + 4095) // 4096), 8, '0')) AS header FROM src",
        "encode_decode": RESTORED, "encode_decode_content_aware": RESTORED, "pack_unpack": RESTORED, "archive_corruption_matrix": CORRUPTION,
        "compress_summary": f"""WITH {src()}, s AS (SELECT path, length(h) // 2 AS n, (length(h) // 2 + 4095) // 4096 AS k FROM src)
          SELECT path, n::BIGINT AS original_size, (49 + 49 * k + n)::BIGINT AS compressed_size, {six('n / (49 + 49 * k + n)')} AS ratio, k::BIGINT AS chunk_count FROM s""",
        "archive_codec_histogram": f"WITH {src()}, {chunks()} SELECT 'zstd' AS algorithm, count(*) AS chunk_count, 100.0::DOUBLE AS share FROM chunks",
        "stratified_split_sizes": f"WITH {SPLIT} SELECT label, split, count(*) AS n FROM split GROUP BY ALL", "stratified_split_rows": f"WITH {SPLIT} SELECT * FROM split",
        "balanced_class_weights": f"SELECT quality AS label, count(*) AS n, {six('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM labels GROUP BY quality",
        "confusion_matrix": f"WITH {MATRIX} SELECT * FROM m", "classification_report": REPORT,
        "accuracy": f"SELECT count(*) AS n, {six('avg((quality = toxic)::INT)')} AS accuracy FROM labels",
        "label_universe": "SELECT quality AS label FROM labels UNION SELECT toxic FROM labels",
        "always_store_strategy": "SELECT 'always_store' AS name, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_original, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_compressed, 1.0::DOUBLE AS ratio FROM documents",
        "labelled_dataset": f"""WITH {src()}, {chunks(16384)}, {COUNTS} SELECT path, chunk_idx, sum(n)::BIGINT AS length, sum(n)::BIGINT AS size_store, {six(_ENTROPY)} AS entropy, true AS best_le_length FROM counts GROUP BY path, chunk_idx""",
        "human_size": f"WITH n AS (SELECT octet_length(encode(coalesce(text, ''))) AS n FROM documents), m AS (SELECT DISTINCT (n * k)::BIGINT AS bytes FROM n, (VALUES (1), (1024), (1048576), (1073741824)) t(k)) SELECT bytes, {sizes_text('bytes')} AS text FROM m",
        "dataset_resume": "SELECT count(*) AS files, count(*) FILTER (doc_id % 2 <> 0) AS pending FROM documents",
    }
    return out
