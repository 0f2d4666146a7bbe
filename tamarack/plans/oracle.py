"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from .adapters import ENTRIES_SQL, HAN_SQL, NOW, PARTS_SQL, SEEN_SQL

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values, written here a second time so that a slip in the library's own shows as a difference.
_PACKAGES = (
    "app bundle framework plugin kext appex xpc prefpane qlgenerator mdimporter saver component vst vst3 photoslibrary "
    "musiclibrary tvlibrary fcpbundle imovielibrary xcodeproj xcworkspace playground xcarchive dsym rtfd scptd lproj logicx "
    "band screenstudio pages numbers key"
)
_NOISE = (
    "node_modules .git .svn .hg __pycache__ .venv venv site-packages Pods DerivedData .gradle .npm .pnpm-store .yarn .cache "
    ".cargo .rustup .Trash Caches Cache .next .nuxt bower_components .idea .build .swiftpm CMakeFiles .tox .mypy_cache "
    ".pytest_cache .terraform"
)
_SYSTEM = "System private usr bin sbin opt Library cores"
_KINDS = {
    3: "pdf doc docx xls xlsx ppt pptx pages numbers key txt md markdown rtf rtfd csv tsv epub mobi odt ods odp tex log",
    4: "png jpg jpeg gif heic heif webp bmp tiff tif svg psd ai sketch fig raw cr2 cr3 nef arw dng ico icns avif",
    5: "mp4 mov mkv avi wmv flv webm m4v mpg mpeg 3gp rmvb",
    6: "mp3 wav flac aac m4a ogg wma aiff aif opus mid midi caf",
    7: "swift c h m mm cpp hpp cc js jsx mjs cjs ts tsx py rb go rs java kt php html htm css scss less vue svelte astro sh zsh "
    "bash json yaml yml toml xml sql lua dart cs r pl gradle plist ipynb",
    8: "zip rar 7z tar gz bz2 xz tgz zst dmg iso pkg jar war apk ipa",
}
_SYLLABLES = dict(zip(
    "文档项目备份中国人小上下天山水火木金土日月年学生书包图报告同会议计表格新旧女张王李",
    "wen dang xiang mu bei fen zhong guo ren xiao shang xia tian shan shui huo mu jin tu ri yue nian xue sheng shu bao tu bao gao tong hui yi ji biao ge xin jiu nu zhang wang li".split(),
    strict=True,
))


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tree(label: str, entries: str) -> str:
    """CTEs `label`: a classified catalog over an entries query."""
    packages, noise, system = _list(_PACKAGES.split()), _list(_NOISE.split()), _list(_SYSTEM.split())
    exts = " ".join(f"WHEN ext IN {_list(v.split())} THEN {k}" for k, v in _KINDS.items())
    last = "CASE WHEN contains({0}, '.') THEN lower(string_split({0}, '.')[-1]) ELSE '' END"
    ext = r"lower(regexp_extract({}, '\.([\x00-\x2D\x2F-\x7F]{{1,8}})$', 1))"
    return f"""
{label}_e AS ({entries}),
{label}_t AS (
  SELECT e.*, '/' || name AS rel_path, 1 AS depth, CAST([] AS VARCHAR[]) AS ancestors FROM {label}_e e WHERE parent_id = 0
  UNION ALL
  SELECT e.*, t.rel_path || '/' || e.name, t.depth + 1, list_append(t.ancestors, t.name) FROM {label}_e e JOIN {label}_t t ON e.parent_id = t.entry_id AND t.is_dir),
{label}_x AS (SELECT * EXCLUDE (size), CASE WHEN size < 2147483648 THEN size ELSE least(size >> 12, 2147483647) * 4096 END AS size,
  translate(name, '{_A}', '{_Z}') AS folded, {ext.format("name")} AS ext FROM {label}_t),
{label} AS (SELECT *, CASE WHEN is_dir AND ext = 'app' THEN 2 WHEN is_dir AND {last.format("name")} NOT IN {packages} THEN 1 {exts} ELSE 0 END AS kind,
  starts_with(name, '.') AS hidden,
  len(list_filter(ancestors, lambda a: a IN {noise} OR starts_with(a, '.'))) > 0 OR coalesce(ancestors[1] IN {system}, FALSE) AS noise,
  len(list_filter(ancestors, lambda a: {last.format("a")} IN {packages})) > 0 AS in_package, TRUE AS user_area FROM {label}_x)"""


_HAN_TREE = "WITH RECURSIVE" + _tree("cat", HAN_SQL.replace("{documents}", "documents")) + f""",
syl(c, s) AS (VALUES {", ".join(f"('{c}', '{x}')" for c, x in _SYLLABLES.items())}),
han AS (SELECT cat.*, a.s || b.s || substr(folded, 3) AS full_key, a.s[1] || b.s[1] || substr(folded, 3) AS initials
  FROM cat JOIN syl a ON a.c = name[1] JOIN syl b ON b.c = name[2] WHERE NOT is_dir)"""
_ENTRIES = ENTRIES_SQL.replace("{documents}", "documents")
CAT = "WITH RECURSIVE" + _tree("cat", _ENTRIES)
BOTH = CAT + "," + _tree("parts", PARTS_SQL.replace("{part}", "part"))
SEEN = f"seen AS ({SEEN_SQL.replace('{events}', 'events')})"
LATEST = f"""{SEEN}, latest AS (SELECT path, max(event_id) AS event_id, arg_max(present, event_id) AS present,
  arg_max(size, event_id) AS size, arg_max(mtime, event_id) AS mtime FROM seen GROUP BY path)"""
CLEAN = "user_area AND NOT noise AND NOT in_package AND NOT hidden"


def _recency(t: str) -> str:
    age = f"greatest({NOW} - {t}, 0)"
    return f"CASE WHEN {age} <= 86400 THEN 60 WHEN {age} <= 604800 THEN 45 WHEN {age} <= 2592000 THEN 30 WHEN {age} <= 31536000 THEN 10 ELSE 0 END"


def quality(needle: str) -> str:
    n, before, here = len(needle), "substr(name, p - 1, 1)", "substr(name, p, 1)"
    starts = f"contains(' _.([+,-', {before})"
    if needle[0].isalpha():
        starts += f" OR regexp_matches({before}, '[0-9]') OR (regexp_matches({before}, '[a-z]') AND regexp_matches({here}, '[A-Z]'))"
    elif needle[0].isdigit():
        starts += f" OR regexp_matches({before}, '[A-Za-z]')"
    word = f"len(list_filter(range(2, length(name) + 1), lambda p: substr(folded, p, {n}) = '{needle}' AND ({starts}))) > 0"
    return f"""CASE WHEN folded = '{needle}' OR (starts_with(folded, '{needle}') AND regexp_matches(substr(folded, {n + 1}), '^\\.[^.]*$')) THEN 4
      WHEN starts_with(folded, '{needle}') THEN 3 WHEN {word} THEN 2 WHEN contains(folded, '{needle}') THEN 1 ELSE 0 END"""


def score(*needles: str) -> str:
    q = [f"({quality(n)})" for n in needles]
    total = " + ".join(f"CASE WHEN {x} > 0 THEN 200 * {x} + 200 ELSE 0 END" for x in q)
    hits = "(" + " + ".join(f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END" for x in q) + ")" if q else "0"
    length = "(" + " + ".join(f"CASE WHEN {x} > 0 THEN {len(n)} ELSE 0 END" for x, n in zip(q, needles, strict=True)) + ")"
    text = f"CASE WHEN {hits} = 0 THEN 400 ELSE ({total}) // greatest({hits}, 1) - 2 * least(greatest(strlen(name) - {length}, 0), 64) END" if q else "400"
    return points(text)


def points(text: str) -> str:
    """Score of a row whose words are worth `text`."""
    return f"""CAST({text} + CASE WHEN {CLEAN} THEN 60 ELSE 0 END + CASE kind WHEN 2 THEN 150 WHEN 1 THEN 20 ELSE 0 END + {_recency("mtime")}
      - CASE WHEN noise THEN 350 ELSE 0 END - CASE WHEN in_package THEN 300 ELSE 0 END - CASE WHEN hidden THEN 200 ELSE 0 END - 5 * least(depth, 16) AS INTEGER)"""


NATURAL = r"""array_to_string(list_transform(regexp_extract_all(folded, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]')
  THEN '0' || lpad(CAST(length(regexp_replace(r, '^0+', '')) AS VARCHAR), 4, '0') || regexp_replace(r, '^0+', '') || lpad(CAST(length(r) AS VARCHAR), 4, '0') ELSE r END), '')"""


def _matches(where: str) -> str:
    return f"{CAT} SELECT entry_id, name FROM cat WHERE {where}"


def _ranked(where: str, points: str, order: str) -> str:
    return f"""{CAT}, hits AS (SELECT entry_id, name, folded, size, mtime, {points} AS score FROM cat WHERE {where}),
      o AS (SELECT *, row_number() OVER (ORDER BY {order}, entry_id) AS rank FROM hits)
      SELECT rank, entry_id, name, score, count(*) OVER () AS total, count(*) OVER () AS sorted_count FROM o"""


def _age(days: int) -> int:
    return NOW - days * 86400


def _matching() -> dict[str, str]:
    has = lambda n: f"contains(folded, '{n}')"
    path = "lower(rel_path) || CASE WHEN is_dir THEN '/' ELSE '' END"
    return {
        "op_f1_name": has("doc-1"), "op_f2_case": "contains(name, 'Doc-1')", "op_f3_path": f"contains({path}, 'src3/en')", "op_f4_descendant": f"contains({path}, 'src1/')",
        "op_f6_glob": r"regexp_matches(folded, '^.*doc.2.*\.png$')", "op_f7_regex": r"regexp_matches(name, '^my_doc\d+5\.')", "op_f8_ext": "ext IN ('md', 'txt')",
        "op_f9_kind": "kind = 4", "op_f10_files": "kind <> 1", "op_f10_folders": "kind = 1", "op_f11_file_or": f"(kind = 1 AND {has('en')}) OR (kind <> 1 AND {has('doc-9')})",
        "op_f12_size": "size > 1500000", "op_f13_modified": "mtime BETWEEN epoch(TIMESTAMP '2024-01-10') AND epoch(TIMESTAMP '2024-01-21') - 1",
        "op_f14_not_ancestor": f"{has('doc')} AND NOT ({has('node_modules')} OR list_contains(ancestors, 'node_modules'))",
        "op_f15_not_path": f"{has('my_doc')} AND NOT contains({path}, 'src1/')", "op_p3_and": f"{has('doc')} AND {has('7')} AND ext = 'pdf'",
        "op_p3_or": f"({has('png')} OR {has('swift')}) AND size < 2000000", "op_p4_not": f"{has('doc')} AND kind <> 5", "op_p9_size": "size BETWEEN 100000 AND 700000",
        "op_p10_date": "mtime BETWEEN epoch(TIMESTAMP '2024-01-29') AND epoch(TIMESTAMP '2024-02-05') - 1", "op_p10_ago": f"mtime BETWEEN {_age(3)} AND {NOW}",
        "op_p7_unknown_key": has("foo:doc"), "op_f21_scan": has("my_doc1"), "op_f23_filter": "kind = 7 AND size > 1000000",
        "op_m1_alternatives": f"{has('doc-1')} OR {has('doc-2')} OR {has('my_doc3')}", "op_p1_paste": f"contains({path}, '/src3/en/')",
    }


REASON = """CASE WHEN rel_path IN ('/src1/en', '/src2') OR starts_with(rel_path, '/src1/en/') OR starts_with(rel_path, '/src2/') THEN 'user path'
  WHEN hidden THEN 'hidden' WHEN list_has_any(CASE WHEN is_dir THEN list_append(ancestors, name) ELSE ancestors END, ['node_modules', 'src5']) THEN 'dependency'
  WHEN in_package THEN 'package' WHEN NOT is_dir AND ext IN ('zip', 'xyz') THEN 'file type' END AS reason"""

TOPICS = """WITH said AS (SELECT CAST(conv_id AS VARCHAR) AS topic_id, turn AS msg_key, role, coalesce(text, '') AS body, conv_id FROM conversations WHERE role IN ('user', 'assistant')),
topics AS (SELECT topic_id, replace(substr(coalesce(arg_min(body, msg_key) FILTER (role = 'user'), ''), 1, 120), chr(10), ' ') AS title,
  ['north', 'south', 'west'][conv_id % 3 + 1] AS provider, 1704067200 + conv_id * 3600 AS modified, conv_id % 11 = 0 AS archived, count(*) AS messages
  FROM said GROUP BY topic_id, conv_id),
messages AS (SELECT topic_id, msg_key, body FROM said UNION ALL SELECT topic_id, -1, title FROM topics),
folded AS (SELECT topic_id, msg_key, body, lower(nfc_normalize(body)) AS f FROM messages)"""


def _both_terms(a: str, b: str) -> str:
    return f"SELECT topic_id FROM folded GROUP BY topic_id HAVING bool_or(contains(f, '{a}')) AND bool_or(contains(f, '{b}'))"


def _relevance(*terms: str) -> str:
    t = "lower(nfc_normalize(title))"
    each = " + ".join(f"CASE WHEN {t} = '{x}' THEN 1000 WHEN starts_with({t}, '{x}') THEN 800 WHEN contains({t}, '{x}') THEN 600 ELSE 250 END" for x in terms)
    return f"CAST(({each}) // {len(terms)} - 2 * least(greatest(strlen({t}) - {sum(map(len, terms))}, 0), 64) + 60 + {_recency('modified')} AS INTEGER)"


GRAMS = r"""grams AS (SELECT DISTINCT topic_id, unnest(list_concat(
  list_transform(range(1, length(f) + 1), lambda i: substr(f, i, 1)), list_transform(range(1, length(f)), lambda i: substr(f, i, 2)),
  list_filter(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)), lambda g: regexp_matches(g, '^[\x00-\x7F]{3}$')))) AS gram FROM folded)"""


def _span_sql(needles: tuple[str, ...], shift: int = 0) -> str:
    hits = " ".join(
        f"UNION ALL SELECT entry_id, p - 1 + {shift} AS a, p - 1 + {len(n) + shift} AS b FROM (SELECT entry_id, folded, unnest(range(1, length(folded) + 1)) AS p FROM cat) WHERE substr(folded, p, {len(n)}) = '{n}'"
        for n in needles
    )[10:]
    return f"""{CAT}, hits AS ({hits}),
      ordered AS (SELECT *, max(b) OVER (PARTITION BY entry_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
      runs AS (SELECT *, sum(CASE WHEN a < reach THEN 0 ELSE 1 END) OVER (PARTITION BY entry_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM ordered),
      merged AS (SELECT entry_id, run, min(a) AS a, max(b) AS b FROM runs GROUP BY ALL),
      shown AS (SELECT entry_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM merged GROUP BY entry_id)
      SELECT entry_id, coalesce(spans, '') AS spans FROM cat LEFT JOIN shown USING (entry_id)"""


def statements() -> dict[str, str]:
    out = {k: _matches(v) for k, v in _matching().items()}
    doc = "contains(folded, 'doc')"
    out |= {
        "op_r3_score": _ranked("contains(folded, 'doc-1')", score("doc-1"), "score DESC"),
        "op_r4_or_score": _ranked("contains(folded, 'doc-1') OR contains(folded, 'my_doc2')", score("doc-1", "my_doc2"), "score DESC"),
        "op_r5_relevance": _ranked("contains(folded, 'my')", score("my"), "score DESC"),
        "op_r6_natural_sort": _ranked(doc, "0", NATURAL),
        "op_r7_sort_size": _ranked(doc, "0", "size DESC"),
        "op_r7_sort_modified": _ranked(doc, "0", "mtime"),
        "op_r8_recent": f"SELECT rank, entry_id, name, score FROM ({_ranked(f'{CLEAN} AND kind <> 1', '0', 'mtime DESC')}) r WHERE rank <= 200",
        "op_f17_option_kind": _ranked(f"{doc} AND kind = 4", score("doc"), "score DESC"),
        "op_r1_quality": f"{CAT} SELECT entry_id, " + ", ".join(f"{quality(n)} AS q_{i}" for i, n in enumerate(("doc", "doc-1", "d", "1", "my_doc12"))) + " FROM cat",
        "op_r9_bounded": f"""{CAT}, hits AS (SELECT entry_id, {score("doc")} AS score FROM cat WHERE {doc}),
            o AS (SELECT entry_id, row_number() OVER (ORDER BY score DESC, entry_id) AS r FROM hits) SELECT entry_id, CASE WHEN r <= 100 THEN r END AS place FROM o""",
        "op_f18_predicates": f"{CAT} SELECT entry_id, contains(folded, 'doc-1') AS p0, ext = 'pdf' AS p1, NOT contains(lower(rel_path) || CASE WHEN is_dir THEN '/' ELSE '' END, 'en') AS p2, size > 1000000 AS p3 FROM cat",
        "op_c1_narrow": f"{CAT} SELECT entry_id, {score('doc-12')} AS score FROM cat WHERE contains(folded, 'doc-12')",
        "op_j1_paths": f"{CAT} SELECT entry_id, rel_path, depth FROM cat",
        "op_j2_resolve": f"{CAT}, {SEEN} SELECT path, entry_id FROM (SELECT DISTINCT path FROM seen) LEFT JOIN cat ON lower(path) = lower(rel_path)",
        "op_m7_parent_join": f"{CAT} SELECT w.parent_id, upper(w.name) AS name, c.entry_id FROM cat w LEFT JOIN cat c ON c.parent_id = w.parent_id AND c.folded = lower(w.name) WHERE w.is_dir",
        "op_s3_classify": f"{CAT} SELECT entry_id, ext, kind, hidden, noise, in_package, size FROM cat",
        "op_a1_report": f"""{CAT} SELECT kind, count(*) AS entries, count(*) FILTER (is_dir) AS dirs, count(*) FILTER ({CLEAN}) AS clean, count(*) FILTER (noise) AS noise,
            count(*) FILTER (in_package) AS in_package, count(*) FILTER (hidden) AS hidden FROM cat GROUP BY kind""",
        "op_q1_validate": f"""WITH e AS ({_ENTRIES}) SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e WHERE parent_id >= entry_id) AS parent_not_before,
            (SELECT count(*) FROM e WHERE parent_id <> 0 AND parent_id NOT IN (SELECT entry_id FROM e WHERE is_dir)) AS no_parent,
            (SELECT count(*) FROM e WHERE name = '' OR contains(name, '/')) AS bad_name,
            (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY parent_id, lower(name) HAVING count(*) > 1)) AS same_name""",
        "op_e18_explain": f"""{CAT}, r AS (SELECT *, entry_id % 101 = 0 AS closed, entry_id % 103 = 0 AS cloud, {REASON} FROM cat),
            p AS (SELECT rel_path AS path FROM r UNION ALL SELECT '/Volumes/disk' || rel_path FROM r UNION ALL SELECT rel_path || '/new' FROM r),
            x AS (SELECT path, rel_path IS NOT NULL AS met, ext, reason, coalesce(closed, FALSE) AS closed, coalesce(cloud, FALSE) AS cloud FROM p LEFT JOIN r ON path = rel_path),
            t AS (SELECT *, CASE WHEN met AND reason IS NULL AND NOT closed AND NOT cloud THEN 'indexed' WHEN starts_with(path, '/Volumes/') THEN 'volume'
              WHEN path = '/src1/en' OR starts_with(path, '/src1/en/') OR path = '/src2' OR starts_with(path, '/src2/') THEN 'user excluded' WHEN reason IS NOT NULL THEN reason
              WHEN closed THEN 'no access' WHEN cloud THEN 'cloud' ELSE 'pending' END AS told FROM x)
            SELECT path, told, CASE WHEN told = 'file type' THEN ext WHEN told <> 'user excluded' THEN NULL WHEN starts_with(path, '/src2') THEN '/src2' ELSE '/src1/en' END AS detail FROM t""",
        "op_s5_exclusion": f"{CAT} SELECT entry_id, {REASON} FROM cat",
        "op_a2_coverage": f"""{CAT}, r AS (SELECT entry_id, rel_path, {REASON} FROM cat), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY entry_id) AS k FROM r WHERE reason IS NOT NULL)
            SELECT reason, count(*) AS n, string_agg(rel_path, ';' ORDER BY k) FILTER (k <= 5) AS examples FROM k GROUP BY reason""",
        "op_a4_coverage_merge": f"{CAT}, r AS (SELECT is_dir, {REASON} FROM cat) SELECT reason, count(*) + count(*) FILTER (NOT is_dir) AS n, 1 + CAST(count(*) FILTER (NOT is_dir) > 0 AS BIGINT) AS parts FROM r WHERE reason IS NOT NULL GROUP BY reason",
        "op_a3_scope_count": f"{CAT}, r AS (SELECT {REASON} FROM cat) SELECT count(*) AS n FROM r WHERE reason IN ('hidden', 'dependency', 'package', 'file type')",
        "op_a5_uncovered": "SELECT DISTINCT source AS root FROM documents WHERE CAST(substring(source, 4) AS INT) % 2 <> 0",
        "op_a12_counters": f"""{CAT}, c AS (SELECT count(*) FILTER (entry_id % 3 <> 0) AS live, count(*) FILTER (entry_id % 3 = 0) AS deleted FROM cat)
            SELECT live, deleted, deleted > greatest(100, (live + deleted) // 4) AS compact FROM c""",
        "op_x9_compact": f"{CAT} SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS new_id FROM cat WHERE entry_id % 3 <> 0",
        "op_x6_sweep": f"""{CAT}, gone AS (SELECT rel_path AS p FROM cat WHERE entry_id IN (2, 1031) OR entry_id % 97 = 0)
            SELECT entry_id, EXISTS (SELECT 1 FROM gone WHERE rel_path = p OR starts_with(rel_path, p || '/')) AS deleted FROM cat""",
        "op_x4_outer_roots": f"""{CAT}, roots AS (SELECT rel_path AS path FROM cat WHERE entry_id % 5 = 0 OR (is_dir AND entry_id % 3 = 0))
            SELECT path FROM roots a WHERE NOT EXISTS (SELECT 1 FROM roots b WHERE starts_with(a.path, b.path || '/'))""",
        "op_x5_reconcile": f"{CAT} SELECT entry_id, rel_path FROM cat WHERE starts_with(rel_path, '/src3/') AND entry_id % 4 = 0",
        "op_x7_inherited": f"""{CAT} SELECT entry_id, coalesce(ancestors[1], '') = 'src4' OR (noise AND coalesce(ancestors[1], '') <> 'src9.app') AS noise, in_package AND ancestors[1] <> 'src9.app' AS in_package
            FROM cat""",
        "op_a10_coalesce": f"WITH {SEEN} SELECT path, bit_or(flags) AS flags, max(event_id) AS event_id FROM seen GROUP BY path",
        "op_x3_apply": f"""{CAT}, {LATEST} SELECT l.path, CASE WHEN NOT present AND entry_id IS NOT NULL THEN 'remove' WHEN NOT present THEN 'ignore' WHEN entry_id IS NULL THEN 'insert'
            WHEN l.size = c.size AND l.mtime = c.mtime THEN 'keep' ELSE 'update' END AS op, event_id FROM latest l LEFT JOIN cat c ON c.rel_path = l.path WHERE event_id > 100""",
        "op_a9_summary": f"""{CAT}, {LATEST}, ops AS (SELECT CASE WHEN NOT present AND entry_id IS NOT NULL THEN 'remove' WHEN NOT present THEN 'ignore' WHEN entry_id IS NULL THEN 'insert'
            WHEN l.size = c.size AND l.mtime = c.mtime THEN 'keep' ELSE 'update' END AS op, event_id FROM latest l LEFT JOIN cat c ON c.rel_path = l.path)
            SELECT op, count(*) AS n, max(event_id) AS last_event FROM ops GROUP BY op""",
        "op_x8_upsert": f"""{CAT}, {LATEST} SELECT rel_path, size, mtime FROM cat WHERE NOT is_dir AND rel_path NOT IN (SELECT path FROM latest)
            UNION ALL SELECT path, size, mtime FROM latest WHERE present""",
        "op_x1_stream": f"""{CAT}, {LATEST} SELECT rel_path, size, mtime FROM cat WHERE NOT is_dir AND rel_path NOT IN (SELECT path FROM latest)
            UNION ALL SELECT path, size, mtime FROM latest WHERE present""",
        "op_p5_whole_path": f"{BOTH} SELECT entry_id, name FROM parts WHERE contains(lower(rel_path), lower((SELECT min(rel_path) FROM parts WHERE NOT is_dir)))",
        "op_s6_loose_files": f"{CAT} SELECT entry_id, rel_path FROM cat WHERE NOT is_dir AND regexp_matches(rel_path, '^/(src3/en|src4/de)/[^/]*$')",
        "op_s8_not_entered": f"""{CAT}, closed AS (SELECT rel_path AS p FROM cat WHERE is_dir AND entry_id % 7 = 0)
            SELECT entry_id, rel_path FROM cat WHERE NOT in_package AND NOT EXISTS (SELECT 1 FROM closed WHERE starts_with(rel_path, p || '/'))""",
        "op_s9_descriptors": f"""{TOPICS}, n AS (SELECT *, CAST(topic_id AS INT) AS id FROM topics), d AS (SELECT *, CASE WHEN id % 3 <> 0 THEN topic_id ELSE 'd' || topic_id END AS key FROM n)
            SELECT key AS topic_id, 'd' || topic_id AS desktop_id, CASE WHEN id % 4 <> 0 AND title <> '' THEN title WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'old ' || topic_id ELSE '' END AS title,
            '/p/' || provider AS project, CASE WHEN id % 5 <> 0 THEN modified ELSE 1704412800 END AS modified, archived, CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 'said' ELSE '' END AS excerpt FROM d""",
        "op_s11_threads": f"""{TOPICS}, n AS (SELECT *, CAST(topic_id AS INT) AS id FROM topics) SELECT topic_id, CASE WHEN id % 3 = 0 THEN 'named ' || topic_id ELSE title END AS title,
            CASE WHEN id % 2 = 0 THEN '/p' ELSE '' END AS project, CASE WHEN id % 4 <> 0 THEN modified ELSE 7 END AS modified, archived, '' AS excerpt, '' AS transcript FROM n WHERE id % 5 <> 0 AND id % 7 <> 0""",
        "op_s13_headers": f"""{TOPICS}, n AS (SELECT *, CAST(topic_id AS INT) AS id FROM topics) SELECT topic_id, '/p/' || provider AS project,
            CASE id % 3 WHEN 0 THEN modified - 1 WHEN 1 THEN modified ELSE modified + 2 END AS modified, archived, '/archived_sessions/' || CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END || '/' || topic_id AS transcript
            FROM n WHERE id % 2 = 0 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0""",
        "op_s14_sessions": f"""{TOPICS}, n AS (SELECT *, CAST(topic_id AS INT) AS id FROM topics) SELECT topic_id, CASE WHEN id % 2 = 0 THEN 'own title' ELSE title END AS title, '/p' AS project,
            modified + CASE WHEN id % 2 = 1 THEN 5 ELSE 0 END AS modified, archived FROM n WHERE id % 3 <> 1 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 13 <> 0 AND id % 17 <> 0""",
        "op_x2_lost": f"""WITH {SEEN} SELECT event_id // 1000 AS part, count(*) AS n, bool_or(event_id % 3000 = 0 OR (path = '/src5/en/my_doc5.TXT' AND flags <> 0)) AS lost FROM seen GROUP BY 1""",
        "op_x4_merge": f"""{CAT}, f AS (SELECT *, starts_with(rel_path, '/src3/') OR starts_with(rel_path, '/src6/de/') AS again FROM cat WHERE NOT is_dir)
            SELECT rel_path, size + CASE WHEN again THEN 1 ELSE 0 END AS size, mtime FROM f WHERE NOT again OR entry_id % 3 <> 0""",
        "op_x10_gap": f"""{CAT}, {LATEST} SELECT rel_path, size, mtime FROM cat WHERE NOT is_dir AND entry_id % 2 = 0 AND rel_path NOT IN (SELECT path FROM latest)
            UNION ALL SELECT path, size, mtime FROM latest WHERE present""",
        "op_e15_extensions": r"""WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(concat('..', p_type, ', .', p_brand, ' ', p_name, ',', p_type), '[\s,]+'),
            lambda x: lower(trim(x, '.'))), lambda x: x <> '') AS e FROM part)
            SELECT p_partkey, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ';') AS exts FROM p""",
        "op_e16_versions": "SELECT p_partkey, p_size < 20 OR (p_size = 20 AND p_partkey % 10 < 5) AS below FROM part",
        "op_t14_resume": TOPICS + r""" SELECT topic_id, 'open ''' || replace(title || ' it''s', '''', '''\''''') || ''' --id ' || topic_id AS command FROM topics""",
        "op_t9_branch": """WITH RECURSIVE m AS (SELECT CAST(conv_id AS VARCHAR) AS conv, turn, CASE WHEN turn >= 2 AND turn % 3 = 2 THEN turn - 2 WHEN turn >= 1 THEN turn - 1 END AS parent FROM conversations),
            forked AS (SELECT conv FROM (SELECT conv, parent FROM m WHERE parent IS NOT NULL GROUP BY conv, parent HAVING count(*) > 1) x GROUP BY conv),
            walk AS (SELECT m.conv, m.turn, m.parent FROM m JOIN (SELECT conv, max(turn) AS last FROM m GROUP BY conv) l ON m.conv = l.conv AND m.turn = l.last
              UNION ALL SELECT m.conv, m.turn, m.parent FROM m JOIN walk w ON m.conv = w.conv AND m.turn = w.parent)
            SELECT conv, turn AS ord FROM m WHERE conv NOT IN (SELECT conv FROM forked) UNION ALL SELECT conv, turn FROM walk WHERE conv IN (SELECT conv FROM forked)""",
        "op_m2_multi": f"""{BOTH}, u AS (SELECT 0 AS ix, 'docs' AS source, entry_id, {score("1", "txt")} AS score FROM cat WHERE contains(folded, '1') AND (ext = 'log' OR contains(folded, 'txt'))
            UNION ALL SELECT 1, 'parts', entry_id, {score("1", "txt")} FROM parts WHERE contains(folded, '1') AND (ext = 'log' OR contains(folded, 'txt'))),
            o AS (SELECT *, row_number() OVER (ORDER BY score DESC, ix, entry_id) AS rank FROM u) SELECT rank, source, entry_id, score FROM o""",
        "op_m2_multi_recent": f"""{BOTH}, u AS (SELECT 0 AS ix, 'docs' AS source, entry_id, mtime FROM cat WHERE {CLEAN} AND kind <> 1 UNION ALL SELECT 1, 'parts', entry_id, mtime FROM parts WHERE {CLEAN} AND kind <> 1),
            o AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, ix, entry_id) AS rank FROM u) SELECT rank, source, entry_id FROM o WHERE rank <= 200""",
        "op_m3_supplement": f"""{CAT}, res AS (SELECT entry_id, {score("doc-1")} AS score FROM cat WHERE contains(folded, 'doc-1')),
            h AS (SELECT 100000 + user_id AS entry_id, min(event_type) AS reason FROM events WHERE event_id % 3 IN (0, 2) GROUP BY 1), live AS (SELECT h.* FROM h JOIN cat USING (entry_id))
            SELECT entry_id, 0 AS tier, reason, score FROM res LEFT JOIN live USING (entry_id) UNION ALL SELECT entry_id, 1, reason, 0 FROM live WHERE entry_id NOT IN (SELECT entry_id FROM res)""",
        "op_m4_additional": f"""{CAT}, {TOPICS[5:]}, u AS (SELECT 'f:' || entry_id AS item, entry_id AS id, CAST({score("doc-1")} AS DOUBLE) AS key, 0 AS is_topic FROM cat WHERE contains(folded, 'doc-1')
            UNION ALL SELECT 't:' || topic_id, NULL, {_relevance("the")}, 1 FROM topics), o AS (SELECT *, row_number() OVER (ORDER BY key DESC, is_topic, id, item) AS rank FROM u)
            SELECT rank, item, key FROM o""",
        "op_m6_provider_scope": f"{TOPICS} SELECT topic_id, provider FROM topics WHERE provider <> 'west'",
        "op_t1_fold": f"{TOPICS} SELECT topic_id, msg_key, f FROM folded",
        "op_t3_literal_and": f"{TOPICS} {_both_terms('the', 'ing')}",
        "op_m8_term_semijoin": f"{TOPICS} {_both_terms('tion', 'que')}",
        "op_t4_postings": f"{TOPICS}, {GRAMS} SELECT gram, count(*) AS n FROM grams GROUP BY gram",
        "op_t5_candidates": f"""{TOPICS}, {GRAMS}, want AS (SELECT unnest(['oue', 'uer', 'éea', 'éeau', 'ée', 'ea', 'au']) AS gram),
            c AS (SELECT topic_id FROM grams WHERE gram IN ('oue', 'uer', 'ée', 'ea', 'au') GROUP BY topic_id HAVING count(*) = 5)
            SELECT topic_id, topic_id IN ({_both_terms("ouer", "éeau")}) AS hit FROM c""",
        "op_t6_topics": f"""{TOPICS}, live AS (SELECT * FROM topics WHERE NOT archived AND provider IN ('north', 'west') AND topic_id IN (SELECT topic_id FROM folded WHERE contains(f, 'de'))),
            o AS (SELECT *, row_number() OVER (ORDER BY modified DESC, topic_id) AS r FROM live) SELECT topic_id, modified, (SELECT count(*) > 20 FROM live) AS has_more FROM o WHERE r <= 20""",
        "op_t7_excerpt": f"""{TOPICS}, o AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY msg_key < 0, msg_key) AS r FROM folded WHERE contains(f, 'tion'))
            SELECT topic_id, substr(body, greatest(1, CAST(instr(f, 'tion') AS INTEGER) - 45), 220) AS excerpt FROM o WHERE r = 1""",
        "op_t8_relevance": f"{TOPICS} SELECT topic_id, {_relevance('in', 'the')} AS score FROM topics",
        "op_a7_topic_count": f"{TOPICS} SELECT count(*) AS n FROM topics WHERE NOT archived AND provider <> 'west'",
        "op_a8_thread_summary": f"{TOPICS} SELECT topic_id, count(*) AS items, max(msg_key) AS last FROM said GROUP BY topic_id",
        "op_t12_titles": f"{TOPICS} SELECT topic_id, title, provider, modified, archived, messages FROM topics",
        "op_k3_topic_upsert": f"""{TOPICS}, n AS (SELECT topic_id, CASE WHEN modified % 3 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN CAST(topic_id AS INT) % 7 <> 0 THEN provider END AS provider, modified,
              CAST(topic_id AS INT) % 13 = 0 OR archived AS archived, CAST(topic_id AS INT) % 5 = 0 AS fresh, modified % 3 = 0 OR CAST(topic_id AS INT) % 7 = 0 OR (CAST(topic_id AS INT) % 13 = 0 AND NOT archived) AS other FROM topics)
            SELECT topic_id, title, provider, modified, archived, CASE WHEN fresh THEN 'insert' ELSE 'update' END AS op FROM n WHERE fresh OR other""",
        "op_k3_title_messages": f"{TOPICS} SELECT topic_id, 'meta' AS msg_key, title || chr(10) || provider AS body FROM topics",
        "op_a5_summary": """WITH r AS (SELECT DISTINCT source AS root FROM documents WHERE CAST(substring(source, 4) AS INT) % 2 <> 0)
            SELECT count(*) AS n, (SELECT string_agg(root, ';' ORDER BY root) FROM (SELECT root FROM r ORDER BY root LIMIT 5) f) AS examples FROM r""",
        "op_m3_sources": _supplemented("tier, CASE WHEN tier = 0 THEN -score END, CASE WHEN tier = 1 THEN -mtime END"),
        "op_m3_by_size": _supplemented("size"),
        "op_k4_message_changes": f"""{TOPICS}, n AS (SELECT topic_id, msg_key, body, CASE WHEN msg_key % 3 = 0 THEN '' WHEN msg_key % 3 = 1 THEN body || '.' ELSE body END AS new, msg_key % 4 <> 2 AS known FROM messages),
            o AS (SELECT topic_id, msg_key, CASE WHEN new = '' AND known THEN 'delete' WHEN new <> '' AND NOT known THEN 'insert' WHEN new <> '' AND new <> body THEN 'update' END AS op FROM n)
            SELECT * FROM o WHERE op IS NOT NULL""",
        "op_m9_reconcile": f"{TOPICS} SELECT topic_id, msg_key FROM messages WHERE msg_key % 2 <> 0",
        "op_x15_archive": f"{TOPICS} SELECT topic_id, CAST(topic_id AS INT) % 4 = 0 AS now FROM topics WHERE archived <> (CAST(topic_id AS INT) % 4 = 0)",
        "op_s10_latest": "SELECT source, lang, arg_max(doc_id, (doc_id % 40) * 1000000000 + doc_id) AS doc_id FROM documents GROUP BY source, lang",
        "op_s12_changed_threads": f"{TOPICS} SELECT topic_id, count(*) AS items, max(msg_key) AS last FROM said WHERE CAST(topic_id AS INT) % 2 = 0 GROUP BY topic_id",
        "op_e6_size_codec": """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice * 100000) AS BIGINT) AS v FROM lineitem)
            SELECT l_orderkey, l_linenumber, CASE WHEN v < 2147483648 THEN v ELSE least(v >> 12, 2147483647) * 4096 END AS kept FROM b""",
        "op_e10_highlight": _span_sql(("doc", "oc", "1")),
        "op_e10_line": _span_sql(("doc", "2", "y", "7", "1"), 2),
        "op_e11_abbreviate": f"{CAT} SELECT entry_id, CASE WHEN rel_path = '/src2/en' THEN '~' WHEN starts_with(rel_path, '/src2/en/') THEN '~' || substr(rel_path, 9) ELSE rel_path END AS shown FROM cat",
        "op_e12_date_text": f"""{CAT}, t AS (SELECT entry_id, make_timestamp(mtime * 1000000) AS ts, make_timestamp(CAST({NOW} AS BIGINT) * 1000000) AS now FROM cat)
            SELECT entry_id, CASE WHEN CAST(ts AS DATE) = CAST(now AS DATE) THEN 'Today ' || strftime(ts, '%H:%M') WHEN CAST(ts AS DATE) = CAST(now AS DATE) - 1 THEN 'Yesterday ' || strftime(ts, '%H:%M')
            WHEN year(ts) = year(now) THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%Y/%-m/%-d') END AS shown FROM t""",
        "op_e13_count_text": f"{CAT} SELECT entry_id, format('{{:,}}', size) AS shown FROM cat",
        "op_e13_size_text": CAT + " SELECT entry_id, CASE WHEN size = 0 THEN 'Zero KB' WHEN size = 1 THEN '1 byte' WHEN size < 1000 THEN size || ' bytes' "
        "WHEN size < 999500 THEN CAST(round(size / 1e3) AS BIGINT) || ' KB' "
        r"WHEN size < 999950000 THEN regexp_replace(CAST(CAST(round(size / 1e6, 1) AS DECIMAL(20,1)) AS VARCHAR), '\.?0+$', '') || ' MB' "
        r"ELSE regexp_replace(CAST(CAST(round(size / 1e9, 2) AS DECIMAL(20,2)) AS VARCHAR), '\.?0+$', '') || ' GB' END AS shown FROM cat",
        "op_e7_alternate_keys": rf"""WITH n AS (SELECT doc_id, text AS name FROM documents)
            SELECT doc_id, CASE WHEN regexp_matches(name, '[^\x00-\x7F]') AND lower(name) <> translate(name, '{_A}', '{_Z}') THEN lower(name) ELSE '' END AS keys FROM n""",
        "op_e7_syllables": f"{_HAN_TREE} SELECT entry_id, full_key AS full, initials FROM han",
        "op_f1_syllables": f"""{_HAN_TREE} SELECT entry_id, 'wd' AS line FROM han WHERE contains(full_key, 'wd') OR contains(initials, 'wd') OR contains(folded, 'wd')
            UNION ALL SELECT entry_id, 'wend' FROM han WHERE contains(full_key, 'wend') OR contains(initials, 'wend') OR contains(folded, 'wend')""",
        "op_f1_no_syllables": f"{_HAN_TREE} SELECT entry_id, name FROM cat WHERE contains(name, '文档') OR contains(folded, 'wd')",
        "op_r2_alternate_points": _HAN_TREE + " SELECT entry_id, " + points("CASE WHEN starts_with(full_key, 'wd') OR starts_with(initials, 'wd') THEN 500 ELSE 350 END - 2 * least(strlen(name) - 2, 64)")
        + " AS score FROM han WHERE contains(full_key, 'wd') OR contains(initials, 'wd')",
        "op_p11_kinds": CAT + " " + " UNION ALL ".join(f"SELECT '{w}' AS word, count(*) FILTER ({'kind = ' + str(k) if k < 9 else 'FALSE'}) AS n FROM cat" for k, w in enumerate("folder app doc image video audio code archive document".split(), 1)),
        "op_p10_zone": _zones(),
        "op_t10_visible_text": r"""WITH c AS (SELECT conv_id, turn, role, turn % 9 AS k, coalesce(text, '') AS t FROM conversations),
            s AS (SELECT *, CASE WHEN role = 'user' THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE t END AS own FROM c)
            SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') OR k IN (2, 4, 8) OR (k = 7 AND role = 'user') OR (k = 3 AND role = 'assistant') OR (k = 5 AND role = 'user') THEN ''
              WHEN k = 1 AND role = 'user' THEN own WHEN k = 1 THEN '<system-reminder data-role="x">no' || chr(10) || 'no</system-reminder>' || chr(10) || '<user_query>' || t || '</user_query> <image_local_path>/p</image_local_path>'
              WHEN k = 3 THEN '<conversation_history_summary>' || regexp_replace(t, '\s+$', '')
              WHEN k = 5 THEN 'Please summarize the' || chr(10) || 'conversation above ' || t || '<cb_summary>' WHEN k = 6 AND role = 'user' THEN regexp_replace(t, '^\s+', '') || chr(10) || '[{' WHEN k = 6 THEN t || chr(10) || '[{'
              WHEN trim(own) = '' THEN '' ELSE own END AS shown FROM s""",
        "op_s5_scope": CAT + """, p AS (SELECT entry_id, rel_path AS p, is_dir, string_split(substr(rel_path, 2), '/') AS parts FROM cat)
            SELECT entry_id, CASE WHEN p = '/src1/en' OR starts_with(p, '/src1/en/') THEN 'user path' WHEN p = '/src2' OR starts_with(p, '/src2/') THEN 'system'
              WHEN starts_with(p, '/src4/') AND p <> '/src4/de' AND NOT starts_with(p, '/src4/de/') THEN 'system' WHEN starts_with(p, '/src3/') THEN 'library'
              WHEN parts[1] IN ('node_modules', 'src5') THEN 'dependency' WHEN len(parts) > 1 AND parts[1] IN ('src9.app', 'src11.PhotosLibrary', 'src13.xcworkspace') THEN 'package'
              WHEN NOT is_dir AND (ends_with(p, '.zip') OR ends_with(p, '.xyz')) THEN 'file type' WHEN p = '/src6/fr' OR starts_with(p, '/src6/fr/') OR parts[1] = 'src8' THEN 'built in' ELSE '' END AS reason FROM p""",
        "op_x11_epochs": """WITH e AS (SELECT user_id % 5 AS source, event_id // 700 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS epoch, event_id AS seq, event_type FROM events),
            h AS (SELECT *, max(epoch) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS highest FROM e) SELECT source, epoch, seq, event_type FROM h WHERE epoch >= highest""",
        "op_x8_upkeep": f"""{CAT}, {LATEST}, told AS (SELECT *, lower(path) AS lp, event_id % 50 = 0 AS is_dir FROM latest
              WHERE NOT starts_with(path, '/src5/') AND NOT list_contains(string_split(path, '/')[:-2], 'src6')),
            old AS (SELECT c.*, lower(rel_path) AS lp, t.path, t.present, t.is_dir AS now_dir, t.size AS now_size, t.mtime AS now_mtime FROM cat c LEFT JOIN told t ON t.lp = lower(c.rel_path)),
            gone AS (SELECT rel_path FROM old WHERE path IS NOT NULL AND (NOT present OR now_dir <> is_dir)),
            stay AS (SELECT * FROM old o WHERE NOT EXISTS (FROM gone g WHERE o.rel_path = g.rel_path OR starts_with(o.rel_path, g.rel_path || '/'))),
            ups AS (SELECT path, mtime, unnest(range(2, len(string_split(path, '/')))) AS n FROM told WHERE present),
            need AS (SELECT array_to_string(string_split(path, '/')[1:n], '/') AS path, max(mtime) AS mtime FROM ups GROUP BY 1),
            fresh AS (SELECT path, is_dir, CASE WHEN is_dir THEN 0 ELSE size END AS size, mtime FROM told WHERE present AND lp NOT IN (SELECT lp FROM stay)
              UNION ALL SELECT path, TRUE, 0, mtime FROM need WHERE lower(path) NOT IN (SELECT lp FROM stay)),
            new AS (SELECT *, (SELECT max(entry_id) FROM cat) + row_number() OVER (ORDER BY replace(path, '/', chr(1))) AS entry_id FROM fresh),
            homes AS (SELECT entry_id, lp FROM stay WHERE is_dir UNION ALL SELECT entry_id, lower(path) FROM new WHERE is_dir)
            SELECT entry_id, parent_id, CASE WHEN path IS NULL THEN name ELSE string_split(path, '/')[-1] END AS name, is_dir, CASE WHEN path IS NULL THEN size WHEN now_dir THEN 0 ELSE now_size END AS size,
              coalesce(now_mtime, mtime) AS mtime, rel_path, depth, array_to_string(ancestors, '/') AS ancestors FROM stay
            UNION ALL SELECT n.entry_id, coalesce(h.entry_id, 0), string_split(path, '/')[-1], is_dir, size, mtime, path, len(string_split(path, '/')) - 1, array_to_string(string_split(path, '/')[2:-2], '/')
            FROM new n LEFT JOIN homes h ON h.lp = lower(regexp_extract(path, '^(.*)/', 1))""",
        "op_t9_replay": """WITH RECURSIVE r AS (SELECT conv_id AS conv, turn AS ord, conv_id % 3 = 2 AND turn = 3 AS fork, turn % 7 = 6 AS note, role = 'user' AND turn % 7 <> 6 AND NOT (conv_id % 3 = 2 AND turn = 3) AS typed,
              CASE WHEN conv_id % 3 = 2 AND turn = 3 THEN 0 WHEN turn % 5 = 4 AND turn % 7 <> 6 THEN turn - 2 WHEN turn >= 1 THEN turn - 1 END AS parent, conv_id % 3 = 0 AND turn % 4 = 3 AS filtered FROM conversations),
            t AS (SELECT *, CASE WHEN typed AND ord = 4 AND conv % 3 = 2 THEN 0 ELSE parent END AS target FROM r),
            branched AS (SELECT conv FROM r WHERE fork OR filtered UNION SELECT conv FROM r WHERE typed AND parent IS NOT NULL GROUP BY conv, parent HAVING count(*) > 1),
            way(conv, ord) AS (SELECT conv, max(ord) FROM t SEMI JOIN branched USING (conv) WHERE NOT fork GROUP BY conv
              UNION SELECT w.conv, b.ord FROM way w JOIN t a ON a.conv = w.conv AND a.ord = w.ord JOIN t b ON b.conv = a.conv AND b.ord = a.target)
            SELECT CAST(conv AS VARCHAR) AS conv, CAST(ord AS BIGINT) AS ord FROM t WHERE NOT fork AND (conv NOT IN (SELECT conv FROM branched) OR (conv, ord) IN (SELECT (conv, ord) FROM way))""",
        "op_f7_budget": CAT + r" SELECT entry_id, regexp_matches(name, '^(?:[a-z]+_|[a-z]+[0-9])+[0-9]*\.(?:md|TXT)$') AS hit FROM cat",
        "op_a13_totals": f"{BOTH}, n AS (SELECT (SELECT count(*) FROM cat) AS c, (SELECT count(*) FROM parts) AS p) SELECT 'docs' AS source, c AS n FROM n UNION ALL SELECT 'parts', p FROM n UNION ALL SELECT 'all', c + p FROM n",
    }
    return out


def _supplemented(order: str) -> str:
    both = f"""SELECT 0 AS ix, 'docs' AS source, entry_id, folded, mtime, size, ext, {score("1", "txt")} AS score FROM cat UNION ALL SELECT 1, 'parts', entry_id, folded, mtime, size, ext, {score("1", "txt")} FROM parts"""
    return f"""{BOTH}, u AS ({both}), res AS (SELECT * FROM u WHERE contains(folded, '1') AND (ext = 'log' OR contains(folded, 'txt'))),
      h AS (SELECT ['docs', 'parts', 'gone'][event_id % 3 + 1] AS source, CASE WHEN event_id % 3 = 0 THEN user_id + 100000 ELSE user_id + 10 END AS entry_id, event_id % 4 AS version, event_type, event_id FROM events),
      d AS (SELECT source, entry_id, arg_max(event_type, event_id) AS reason FROM h WHERE version = 0 OR (source = 'docs' AND version = 2) OR (source = 'parts' AND version = 3) GROUP BY ALL),
      rows_ AS (SELECT u.*, reason, CASE WHEN r.entry_id IS NULL THEN 1 ELSE 0 END AS tier FROM u LEFT JOIN res r ON r.ix = u.ix AND r.entry_id = u.entry_id LEFT JOIN d ON d.source = u.source AND d.entry_id = u.entry_id
        WHERE r.entry_id IS NOT NULL OR reason IS NOT NULL)
      SELECT row_number() OVER (ORDER BY {order}, ix, entry_id) AS rank, source, entry_id, tier, reason, count(*) OVER () AS total, count(*) OVER () AS sorted_count FROM rows_"""


def _zones() -> str:
    """Bounds of days as local times at fixed distances from UTC: -5 h (-4 from 10 March 2024), +5:30 h, +1 h (+2 from 31 March)."""
    shift = {
        "America/New_York": "m - CASE WHEN m < 1710054000 THEN 18000 ELSE 14400 END", "Asia/Kolkata": "m + 19800", "Europe/Berlin": "m + CASE WHEN m < 1711846800 THEN 3600 ELSE 7200 END",
    }
    # 2024-04-01T00:00Z is the evening of Sunday, 31 March in New York, and Monday in the other two
    west = {"today": ("03-31", "03-31"), "yesterday": ("03-30", "03-30"), "week": ("03-31", "04-06"), "month": ("03-01", "03-31")}
    east = {"today": ("04-01", "04-01"), "yesterday": ("03-31", "03-31"), "week": ("04-01", "04-07"), "month": ("04-01", "04-30")}
    both = {"day": ("01-15", "01-15"), "span": ("01-10", "01-12"), "after": ("02-04", "12-31"), "before": ("01-01", "01-04")}
    rows = []
    for zone, local in shift.items():
        for what, (a, b) in ((west if zone.startswith("America") else east) | both).items():
            low = "DATE '1970-01-01'" if what == "before" else f"DATE '2024-{a}'"
            rows.append(f"SELECT '{what} {zone}' AS what, count(*) FILTER (CAST(make_timestamp(({local}) * 1000000) AS DATE) BETWEEN {low} AND DATE '2024-{b}') AS n FROM e")
    return "WITH e AS (SELECT CAST(1704067200 + event_id * 997 % 8640000 AS BIGINT) AS m FROM events) " + " UNION ALL ".join(rows)
