"""DuckDB SQL for the queries over the reference's own operators."""

from __future__ import annotations

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SPACE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\p{Z}]"
NUM = r"(-?[0-9]+(?:\.[0-9]+)?)"
BOX = rf"<box>{SPACE}*\[{SPACE}*" + rf"{SPACE}*,{SPACE}*".join([NUM] * 4) + rf"{SPACE}*\]{SPACE}*</box>"
CORNERS = ("x0", "y0", "x1", "y1")
NAN = "isnan({0})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def clamp(x: str, low: str, high: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN {x} ELSE least(greatest({x}, {low}), {high}) END)"


def boxed(suffix: str = "", prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}{suffix} AS {c}" for c in CORNERS)


UI = """ui AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey AS VARCHAR) AS image_path, p_name AS query,
    l_discount * 5.0::DOUBLE AS nx0, l_tax * 5.0::DOUBLE AS ny0,
    l_discount * 5.0::DOUBLE + l_quantity / 100.0::DOUBLE AS nx1,
    l_tax * 5.0::DOUBLE + l_linenumber::DOUBLE / 500.0::DOUBLE AS ny1,
    (640 + (l_orderkey % 5) * 320)::INTEGER AS img_w, (480 + (l_orderkey % 4) * 240)::INTEGER AS img_h
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FRAME = UI + ", frame AS (SELECT " + KEYS + ", image_path, query, " + ", ".join(
    f"{clamp('n' + c, '0.0::DOUBLE', '1.0::DOUBLE')} * img_{'w' if c[0] == 'x' else 'h'}::DOUBLE AS {c}" for c in CORNERS
) + ", img_w, img_h FROM ui)"


def kept(table: str, most: int | None = None) -> str:
    upper = f" AND length({strip('query')}) <= {most}" if most else ""
    return (
        f"SELECT * FROM {table} WHERE x1 - x0 >= 5.0::DOUBLE AND y1 - y0 >= 5.0::DOUBLE AND NOT isnan(x1 - x0) AND NOT isnan(y1 - y0) "
        f"AND length({strip('query')}) >= 3{upper}"
    )


def params(w: str, h: str) -> str:
    """Columns scale, content_w, content_h, then pads in an outer query."""
    s = f"least(1024.0::DOUBLE / {w}::DOUBLE, 768.0::DOUBLE / {h}::DOUBLE)"
    return (
        f"{s} AS scale, least(1024, round_even({w}::DOUBLE * {s}, 0)::INTEGER) AS content_w, "
        f"least(768, round_even({h}::DOUBLE * {s}, 0)::INTEGER) AS content_h"
    )


PADS = "(1024 - content_w) // 2 AS pad_x, (768 - content_h) // 2 AS pad_y"


def to_frame(c: str) -> str:
    pad, size = ("pad_x", "content_w") if c[0] == "x" else ("pad_y", "content_h")
    x = f"((({c}::FLOAT) * (scale::FLOAT))::FLOAT + ({pad}::FLOAT))::FLOAT"
    return clamp(x, f"{pad}::FLOAT", f"({pad}::FLOAT + {size}::FLOAT)::FLOAT")


def from_frame(x: str, axis: str) -> str:
    pad, size = ("pad_x", "orig_w") if axis == "x" else ("pad_y", "orig_h")
    return clamp(f"((({x})::FLOAT - {pad}::FLOAT)::FLOAT::DOUBLE / (scale::FLOAT)::DOUBLE)::FLOAT", "0::FLOAT", f"{size}::FLOAT")


FRAMED = (
    FRAME
    + ", kept AS ("
    + kept("frame")
    + "), sized AS (SELECT *, "
    + params("img_w", "img_h")
    + " FROM kept), padded AS (SELECT *, "
    + PADS
    + ", img_w AS orig_w, img_h AS orig_h FROM sized), framed AS (SELECT *, "
    + ", ".join(f"{to_frame(c)} AS {c}_f" for c in CORNERS)
    + " FROM padded)"
)
ROUNDED = "rounded AS (SELECT *, " + ", ".join(f"round_even({c}_f::DOUBLE, 0)::BIGINT AS {n}" for c, n in zip(CORNERS, "abcd")) + " FROM framed)"


def completion(shift: int) -> str:
    def box(a, b, c, d):
        return f"'<box> [' || ({a}) || ', ' || ({b}) || ', ' || ({c}) || ', ' || ({d}) || '] </box>'"

    return f"""CASE (l_orderkey + l_linenumber + l_partkey + {shift}) % 8
      WHEN 0 THEN {box('a', 'b', 'c', 'd')}
      WHEN 1 THEN {box('a - 10', 'b - 10', 'c + 10', 'd + 10')}
      WHEN 2 THEN {box('a', 'b', 'c - floor((c - a) / 5.0::DOUBLE)::BIGINT', 'd')}
      WHEN 3 THEN 'The text is at <box>[' || a || ',' || b || ',' || c || ',' || d || ']</box> or <box>[1,2,3,4]</box>'
      WHEN 4 THEN 'no box here'
      WHEN 5 THEN {box('c', 'd', 'a', 'b')}
      WHEN 6 THEN chr(10) || ' ' || chr(9) || '<box> [' || a || '.25, ' || b || '.5, ' || c || '.75, ' || d || '] </box>' || chr(9) || ' ' || chr(10)
      ELSE '<box> [0, 0, 1024, 768] </box>' END"""


def parsed(text: str, prefix: str) -> str:
    return ", ".join(f"TRY_CAST(NULLIF(regexp_extract({text}, '{BOX}', {i}), '') AS DOUBLE)::FLOAT AS {prefix}{c}" for i, c in enumerate(CORNERS, 1))


COMPLETED = (
    FRAMED + ", " + ROUNDED + f", completed AS (SELECT *, {completion(0)} AS completion, {completion(3)} AS micro FROM rounded), "
    + "boxes AS (SELECT *, " + parsed("completion", "p") + ", " + parsed("micro", "m") + " FROM completed)"
)


def extent(low: str, high: str) -> str:
    return f"greatest((({high}) - ({low}))::FLOAT, 0::FLOAT)"


SHARED = f"({extent('greatest(px0, x0_f)', 'least(px1, x1_f)')} * {extent('greatest(py0, y0_f)', 'least(py1, y1_f)')})::FLOAT"


def share(x0, y0, x1, y1) -> str:
    area = f"({extent(x0, x1)} * {extent(y0, y1)})::FLOAT"
    return f"CASE WHEN px0 IS NOT NULL THEN (shared::DOUBLE / greatest({area}, 1e-7::DOUBLE::FLOAT)::DOUBLE)::FLOAT END"


SCORED = (
    COMPLETED + f", met AS (SELECT *, {SHARED} AS shared FROM boxes), covered AS (SELECT *, "
    + share("x0_f", "y0_f", "x1_f", "y1_f") + " AS coverage, " + share("px0", "py0", "px1", "py1") + ' AS "precision" FROM met), '
    + """scored AS (SELECT *,
      CASE WHEN px0 IS NULL THEN 0.0::DOUBLE WHEN coverage::DOUBLE < 0.9::DOUBLE THEN -1.0::DOUBLE
        ELSE 0.6::DOUBLE * coverage::DOUBLE + 0.4::DOUBLE * "precision"::DOUBLE END AS box_reward,
      CASE WHEN regexp_full_match(""" + strip("completion") + f", '{BOX}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS format_reward FROM covered)"
)


def held(c: str) -> str:
    return clamp(f"p{c}", "0::FLOAT", "1024::FLOAT" if c[0] == "x" else "768::FLOAT")


def crop(c: str) -> str:
    low, high, most = ("h" + c[0] + "0", "h" + c[0] + "1", 1024 if c[0] == "x" else 768)
    margin = f"({high}::DOUBLE - {low}::DOUBLE) * 0.15::DOUBLE"
    if c[1] == "0":
        return f"greatest(0, floor({low}::DOUBLE - {margin})::INTEGER)"
    return f"least({most}, ceil({high}::DOUBLE + {margin})::INTEGER)"


ZOOM = (
    COMPLETED + ", macro AS (SELECT " + KEYS + ", px0, mx0, my0, mx1, my1, " + ", ".join(f"CASE WHEN px0 IS NOT NULL THEN {held(c)} END AS h{c}" for c in CORNERS)
    + " FROM boxes), zooms AS (SELECT *, coalesce((hx1 - hx0)::FLOAT >= 4::FLOAT AND (hy1 - hy0)::FLOAT >= 4::FLOAT, FALSE) AS zoom FROM macro), "
    + "cropped AS (SELECT *, " + ", ".join(f"{crop(c)} AS c{c}" for c in CORNERS) + " FROM zooms WHERE zoom), "
    + "fitted AS (SELECT *, cx1 - cx0 AS orig_w, cy1 - cy0 AS orig_h, " + params("(cx1 - cx0)", "(cy1 - cy0)") + " FROM cropped), "
    + f"ready AS (SELECT *, {PADS} FROM fitted)"
)


def projected(values: tuple[str, str, str, str]) -> str:
    return ", ".join(
        f"({from_frame(v, c[0])} + c{c[0]}0::FLOAT)::FLOAT AS r{c}" for v, c in zip(values, CORNERS)
    )


def _zoom_pixels() -> str:
    """What the model sees: the right colour in a frame's middle, and in the zoom's the colour of the half where the crop's middle lies."""

    def colour(side: str) -> str:
        blue, red, green = (13, "k % 7 * 7", "k % 5 * 8") if side == "l" else (11, "[3, 8, 12, 40, 45, 50][(k % 6 + 1)::INTEGER]", "k % 9 * 4")
        return f"{red} AS {side}r, {green} AS {side}g, CASE WHEN k % {blue} = 0 THEN 255 ELSE k % 8 END AS {side}b"

    def answer(side: str, prefix: str) -> str:
        values = (f"{side}r", f"{side}g", f"{side}r + 10 + q", f"{side}g + {side}b % 8")
        return ", ".join(f"CASE WHEN {side}b <> 255 THEN ({v})::FLOAT END AS {prefix}{c}" for v, c in zip(values, CORNERS))

    hold = ", ".join(f"least(greatest(p{c}, 0::FLOAT), {64 if c[0] == 'x' else 48}::FLOAT) AS h{c}" for c in CORNERS)
    low = lambda a: f"greatest(0, floor(h{a}0::DOUBLE - (h{a}1::DOUBLE - h{a}0::DOUBLE) * 0.15::DOUBLE)::INTEGER)"
    high = lambda a, most: f"least({most}, ceil(h{a}1::DOUBLE + (h{a}1::DOUBLE - h{a}0::DOUBLE) * 0.15::DOUBLE)::INTEGER)"
    return f"""WITH {UI}, coloured AS (SELECT {KEYS}, length(query) % 3 AS q, l_orderkey AS k FROM ui),
 seen AS (SELECT *, {colour("l")}, {colour("r")} FROM coloured), first AS (SELECT *, {answer("r", "p")} FROM seen),
 macro AS (SELECT *, px0 AS parsed, {hold} FROM first),
 zooms AS (SELECT *, coalesce(hx1 - hx0 >= 4::FLOAT AND hy1 - hy0 >= 4::FLOAT AND parsed IS NOT NULL, FALSE) AS zoom FROM macro),
 cropped AS (SELECT *, {low("x")} AS cx0, {low("y")} AS cy0, {high("x", 64)} AS cx1, {high("y", 48)} AS cy1 FROM zooms WHERE zoom),
 sized AS (SELECT *, cx1 - cx0 AS orig_w, cy1 - cy0 AS orig_h, least(64::DOUBLE / (cx1 - cx0), 48::DOUBLE / (cy1 - cy0)) AS scale FROM cropped),
 fitted AS (SELECT *, least(64, round_even(orig_w * scale, 0)::INTEGER) AS content_w, least(48, round_even(orig_h * scale, 0)::INTEGER) AS content_h FROM sized),
 ready AS (SELECT *, (64 - content_w) // 2 AS pad_x, (48 - content_h) // 2 AS pad_y, (cx0 + cx1) / 2.0::DOUBLE < 32 AS on_left FROM fitted),
 chosen AS (SELECT *, CASE WHEN on_left THEN lr ELSE rr END AS sr, CASE WHEN on_left THEN lg ELSE rg END AS sg, CASE WHEN on_left THEN lb ELSE rb END AS sb FROM ready),
 second AS (SELECT *, {answer("s", "m")} FROM chosen), r AS (SELECT *, {projected(("mx0", "my0", "mx1", "my1"))} FROM second)
 SELECT {KEYS}, CASE WHEN parsed IS NULL THEN 'miss' ELSE 'too_small' END AS path, {", ".join(f"CASE WHEN parsed IS NOT NULL THEN h{c} END AS {c}" for c in CORNERS)} FROM zooms WHERE NOT zoom
 UNION ALL SELECT {KEYS}, CASE WHEN mx0 IS NULL THEN 'macro_fallback' ELSE 'refined' END, {", ".join(f"CASE WHEN mx0 IS NULL THEN h{c} ELSE r{c} END" for c in CORNERS)} FROM r"""


PAGES = r"""pages_b AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS k,
    CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1332.5::DOUBLE ELSE 1025.0::DOUBLE END AS original,
    string_split(text, chr(10)) AS lines FROM documents),
 category AS (SELECT * FROM pages_b WHERE lang = 'en'),
 ordered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS page_ordinal FROM category),
 raw AS (SELECT doc_id, page_ordinal, k, original, i - 1 AS i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM ordered)),
 cell AS (SELECT doc_id, page_ordinal, original, i::INTEGER AS i, CASE WHEN i % 11 = 10 THEN '  ' ELSE line END AS text,
    (40 + (i % 3) * 300)::DOUBLE * k AS x, (20 + (i % 40) * 24)::DOUBLE * k AS y,
    least(length(line) * 6, 280)::DOUBLE * k AS w, 18.0::DOUBLE * k AS h FROM raw),
 extent AS (SELECT doc_id, max(x + w) AS max_x, max(y + h) AS max_y, any_value(original) AS original FROM cell GROUP BY doc_id),
 scaled AS (SELECT *, (max_x > 1025 * 1.05::DOUBLE OR max_y > 1025 * 1.05::DOUBLE) AND original IS NOT NULL AND original <> 0 AS rescaled FROM extent),
 scales AS (SELECT *, CASE WHEN rescaled THEN 1025::DOUBLE / original ELSE 1.0::DOUBLE END AS s FROM scaled)"""
CELLS = (
    PAGES + ", cells AS (SELECT CAST(page_ordinal AS VARCHAR) AS image_path, " + strip("text") + " AS query, "
    + ", ".join(f"least(greatest(({v}) * s, 0.0::DOUBLE), 1025.0::DOUBLE) AS {c}" for v, c in zip(("x", "y", "x + w", "y + h"), CORNERS))
    + ", 1025 AS img_w, 1025 AS img_h FROM cell JOIN scales USING (doc_id) WHERE " + strip("text") + " <> '')"
)
FILES = r"""files AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS rel_path FROM pages),
 named AS (SELECT *, regexp_extract(rel_path, '([^/]*)/*$', 1) AS basename FROM files),
 image_index AS (SELECT 'web' AS source, basename, min(page_id) AS page_id, arg_min(rel_path, page_id) AS rel_path, count(*) AS copies FROM named GROUP BY basename),
 entry AS (SELECT doc_id, 'img/' || (doc_id % 400) || CASE WHEN doc_id % 2 = 0 THEN '.html' ELSE '' END AS img_filename FROM documents),
 entry_named AS (SELECT *, regexp_extract(img_filename, '([^/]*)/*$', 1) AS basename FROM entry)"""
CHATS = """spoken AS (SELECT conv_id, turn, text, list_transform(string_split(text, ' '), lambda w: length(w)::BIGINT) AS ids FROM conversations),
 chat AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS input_ids, len(arg_min(ids, turn)) AS prompt_length,
   string_agg(coalesce(text, 'None'), '' ORDER BY turn) AS text, conv_id // 8 AS batch_id FROM spoken GROUP BY conv_id),
 masked AS (SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN i <= prompt_length THEN -100 ELSE x END) AS labels FROM chat)"""
MESSY = """messy AS (SELECT *, CASE WHEN l_partkey % 97 = 0 THEN FALSE ELSE TRUE END AS has_box, CASE WHEN l_partkey % 89 = 0 THEN '' ELSE query END AS instruction FROM ui)"""
PROMPT = """replace('Find the bounding box for the text: "{query}". Output format: <box> [x0, y0, x1, y1] </box>', '{query}', query)"""
ANSWER = "'<box> [' || a || ', ' || b || ', ' || c || ', ' || d || '] </box>'"
ROW_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
FLAT = f"WITH {UI}, {MESSY} SELECT image_path AS img_filename, instruction, {boxed(prefix='n')} FROM messy WHERE has_box AND instruction <> ''"


def permuted(source: str, at: str, n: str, seed: str, name: str, walks: int = 4) -> str:
    """``source`` with where the seeded permutation takes ``at``; a number that falls outside walks on, a few times in SQL."""
    digest = "('0x' || substr(md5({0} || '|' || s.k || '|' || sd), 1, 15))::BIGINT"
    steps = "list_transform(range(8), lambda k: {'x': 0::BIGINT, 'y': 0::BIGINT, 'k': k::BIGINT})"
    step = f"""{{'x': CASE WHEN s.k % 2 = 0 THEN (acc.x + {digest.format('acc.y')}) % wide ELSE acc.x END,
        'y': CASE WHEN s.k % 2 = 1 THEN (acc.y + {digest.format('acc.x')}) % high ELSE acc.y END, 'k': s.k}}"""
    out = f"SELECT *, {at} AS landed, {seed} AS sd, {n} AS n, ceil(sqrt({n}::DOUBLE))::BIGINT AS wide FROM ({source})"
    out = f"SELECT *, (n + wide - 1) // wide AS high FROM ({out})"
    for k in range(walks):
        walked = f"list_reduce({steps}, lambda acc, s: {step}, {{'x': landed % wide, 'y': landed // wide, 'k': -1::BIGINT}})"
        walked = f"SELECT *, {walked} AS spot FROM ({out})"
        out = f"SELECT * EXCLUDE (spot) REPLACE ({'spot.x + spot.y * wide' if k == 0 else 'CASE WHEN landed < n THEN landed ELSE spot.x + spot.y * wide END'} AS landed) FROM ({walked})"
    return f"SELECT * EXCLUDE (sd, n, wide, high) RENAME (landed AS {name}) FROM ({out})"


def mixed(a: str, b: str) -> str:
    """CTEs picks, mixed over children a and b, each a query with row_key."""
    first = lambda i: permuted(f"SELECT {i} AS child, row_key, row_number() OVER (ORDER BY row_key) - 1 AS nth FROM child{i}", "nth", f"(SELECT n FROM n{i})", f"'{i}|17'", "f")
    return f"""child0 AS ({a}), child1 AS ({b}),
 n0 AS (SELECT count(*) AS n FROM child0), n1 AS (SELECT count(*) AS n FROM child1),
 wanted AS (SELECT n0.n AS c0, greatest(1, round_even(round_even(n0.n::DOUBLE / (0.7::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE)), 0) * (0.3::DOUBLE / (0.7::DOUBLE + 0.3::DOUBLE)), 0)::BIGINT) AS c1 FROM n0),
 first0 AS ({first(0)}),
 first1 AS ({first(1)}),
 picks AS (SELECT child, row_key, f AS pick, f AS place FROM first0
   UNION ALL SELECT 1, row_key, p, p + (SELECT c0 FROM wanted) FROM (SELECT unnest(range(0, (SELECT c1 FROM wanted))) AS p) t JOIN first1 ON first1.f = t.p % (SELECT n FROM n1)),
 mixed AS ({permuted("SELECT * FROM picks", "place", "(SELECT c0 + c1 FROM wanted)", "'17'", "pos")})"""


UI_CHILD = f"SELECT concat_ws('|', {KEYS}, x0, y0) AS row_key, image_path, query, x0, y0, x1, y1, img_w, img_h FROM kept"
MIX_A = f"{FRAMED}, {CELLS}, kept_cells AS ({kept('cells', 50)})"
#: A cell's row key is a digest of printed doubles, which the engines print alike.
CELL_CHILD = (
    "SELECT DISTINCT md5(concat_ws('|', image_path, query, x0, y0, x1, y1)) AS row_key, image_path, query, x0, y0, x1, y1, img_w, img_h FROM kept_cells"
)
#: The training mixture row by row: ui_rows (pos, h), cell_rows (nth) and train (child, pick, pos) with rounded boxes a to d.
BUILT = (
    f"WITH {FRAMED}, {ROUNDED}, {CELLS}, kept_cells AS ({kept('cells', 50)}), "
    + f"ui_rows AS (SELECT *, greatest(1, floor(total * 0.01::DOUBLE)::BIGINT) AS h FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {KEYS}, x0, y0, 17)), {KEYS}, x0, y0) - 1 AS pos, count(*) OVER () AS total FROM rounded)), "
    + f"sized_b AS (SELECT *, {params('img_w', 'img_h')} FROM kept_cells), padded_b AS (SELECT *, {PADS} FROM sized_b), "
    + f"framed_b AS (SELECT *, {', '.join(f'{to_frame(c)} AS {c}_f' for c in CORNERS)} FROM padded_b), "
    + f"cell_rows AS (SELECT query, {', '.join(f'round_even({c}_f::DOUBLE, 0)::BIGINT AS {n}' for c, n in zip(CORNERS, 'abcd'))}, row_number() OVER (ORDER BY image_path, query, x0, y0, x1, y1) - 1 AS nth FROM framed_b), "
    + mixed("SELECT pos AS row_key FROM ui_rows WHERE pos >= h", "SELECT nth AS row_key FROM cell_rows")
    + ", train AS (SELECT m.child, m.pick, m.pos, query, a, b, c, d FROM mixed m JOIN ui_rows u ON m.child = 0 AND u.pos = m.row_key"
    + " UNION ALL SELECT m.child, m.pick, m.pos, query, a, b, c, d FROM mixed m JOIN cell_rows r ON m.child = 1 AND r.nth = m.row_key)"
)
JOIN = ", ".join
# Every supplier's image of one colour, and how it fits into a frame of 64 by 48.
PLAIN_IMAGES = """plain AS (SELECT s_suppkey AS id, (40 + 50 * (s_suppkey % 3))::INTEGER AS r, (90 + s_suppkey % 100)::INTEGER AS g, (200 - 60 * (s_suppkey % 3))::INTEGER AS b,
   [16, 9, 40][(s_suppkey % 3 + 1)::INTEGER] AS w, [9, 16, 40][(s_suppkey % 3 + 1)::INTEGER] AS h FROM supplier)"""
SMALL_FRAMES = """scales_of AS (SELECT *, least(64.0::DOUBLE / w, 48.0::DOUBLE / h) AS scale FROM plain),
 contents AS (SELECT *, least(64, round_even(w * scale, 0)::INTEGER) AS content_w, least(48, round_even(h * scale, 0)::INTEGER) AS content_h FROM scales_of),
 fitted AS (SELECT *, (64 - content_w) // 2 AS pad_x, (48 - content_h) // 2 AS pad_y FROM contents)"""

SQL: dict[str, str] = {
    "ui_flatten_nested": FLAT,
    "ui_flatten_flat": FLAT,
    "ui_frame_normalized": f"WITH {FRAME} SELECT * FROM frame",
    "ui_frame_absolute": f"WITH {UI} SELECT {KEYS}, image_path, query, {boxed(prefix='n')}, img_w, img_h FROM ui",
    "filter_ui": f"WITH {FRAME} {kept('frame')}",
    "load_quality_counts": f"""WITH {UI}, {MESSY}, marked AS (SELECT *, 's' || (l_orderkey % 3) AS source, l_orderkey % 10 <> 0 AS found FROM messy)
      SELECT source, count(DISTINCT image_path) FILTER (NOT found) AS missing,
        count(*) FILTER (found AND has_box AND instruction <> '') AS kept,
        count(*) FILTER (found AND NOT (has_box AND instruction <> '')) AS skipped,
        count(DISTINCT image_path) FILTER (found) AS screenshots FROM marked GROUP BY source""",
    "image_index_dedup": f"WITH {FILES} SELECT source, basename, page_id, rel_path, copies FROM image_index",
    "image_lookup": f"WITH {FILES} SELECT doc_id, img_filename, page_id, rel_path FROM entry_named JOIN image_index USING (basename)",
    "image_missing": f"WITH {FILES} SELECT doc_id, img_filename FROM entry_named WHERE basename NOT IN (SELECT basename FROM image_index)",
    "image_sizes_distinct": f"WITH {UI} SELECT DISTINCT image_path AS rel_path, img_w, img_h FROM ui",
    "page_category_filter": "SELECT count(*) FILTER (lang = 'en') AS kept, count(*) AS total FROM documents",
    "page_ordinals": f"WITH {PAGES} SELECT doc_id, page_ordinal FROM ordered",
    "cells_flatten": f"WITH {PAGES} SELECT doc_id, i, text, x, y, w, h FROM cell",
    "cells_rescale": f"WITH {PAGES} SELECT doc_id, max_x, max_y, rescaled, s AS scale_x, s AS scale_y FROM scales",
    "cell_frame": f"WITH {CELLS} SELECT * FROM cells",
    "filter_cells": f"WITH {CELLS} {kept('cells', 50)}",
    "letterbox_params": f"WITH {UI}, sizes AS (SELECT DISTINCT img_w, img_h FROM ui), p AS (SELECT *, {params('img_w', 'img_h')} FROM sizes) SELECT img_w, img_h, scale, {PADS}, content_w, content_h FROM p",
    "letterbox_boxes": f"WITH {FRAMED} SELECT {KEYS}, x0_f, y0_f, x1_f, y1_f FROM framed",
    "unletterbox_roundtrip": f"WITH {FRAMED} SELECT {KEYS}, " + JOIN(f"{from_frame(c + '_f', c[0])} AS {c}_o" for c in CORNERS) + " FROM framed",
    "prompt_render": f"WITH {FRAMED} SELECT {KEYS}, {PROMPT} AS prompt FROM framed",
    "answer_render": f"WITH {FRAMED}, {ROUNDED} SELECT {KEYS}, {ANSWER} AS answer FROM rounded",
    "chat_messages": f"""WITH {FRAMED}, {ROUNDED} SELECT {KEYS}, 0 AS turn, 'user' AS role, 0 AS part, 'image' AS type, NULL AS text FROM rounded
      UNION ALL SELECT {KEYS}, 0, 'user', 1, 'text', {PROMPT} FROM rounded UNION ALL SELECT {KEYS}, 1, 'assistant', 0, 'text', {ANSWER} FROM rounded""",
    "sft_rows": f"""WITH {FRAMED}, {ROUNDED}, texts AS (SELECT *, {PROMPT} AS prompt, {ANSWER} AS answer FROM rounded),
      ids AS (SELECT {KEYS}, answer, list_transform(string_split(prompt || ' ' || answer, ' '), lambda w: length(w)::BIGINT) AS i, len(string_split(prompt, ' ')) AS n FROM texts)
      SELECT {KEYS}, answer, array_to_string(i, ',') AS input_ids,
        array_to_string(list_transform(i, lambda x, k: CASE WHEN k <= n THEN -100 ELSE x END), ',') AS labels, len(i)::INTEGER AS n_ids FROM ids""",
    "grpo_rows": f"WITH {FRAMED} SELECT {KEYS}, 'user' AS role, {PROMPT} AS content, " + boxed("_f") + " FROM framed",
    "label_mask": f"WITH {CHATS} SELECT conv_id, prompt_length::INTEGER AS prompt_length, array_to_string(labels, ',') AS labels FROM masked",
    "pad_batch": f"""WITH {CHATS}, longest AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS length FROM masked)
      SELECT conv_id, batch_id, length::INTEGER AS length,
        array_to_string(list_concat(input_ids, list_transform(range(0, length - len(input_ids)), lambda x: 0)), ',') AS input_ids,
        array_to_string(list_concat(list_transform(input_ids, lambda x: 1), list_transform(range(0, length - len(input_ids)), lambda x: 0)), ',') AS attention_mask,
        array_to_string(list_concat(labels, list_transform(range(0, length - len(input_ids)), lambda x: -100)), ',') AS labels FROM longest""",
    "completion_texts": f"WITH {CHATS} SELECT conv_id, text FROM chat",
    "parsed_boxes": f"WITH {COMPLETED} SELECT {KEYS}, {boxed(prefix='p')} FROM boxes",
    "format_reward": f"WITH {SCORED} SELECT {KEYS}, format_reward AS reward FROM scored",
    "coverage_precision": f'WITH {SCORED} SELECT {KEYS}, coverage, "precision" FROM scored',
    "bbox_reward": f"WITH {SCORED} SELECT {KEYS}, box_reward AS reward FROM scored",
    "reward_summary": f"WITH {SCORED} SELECT round(avg(format_reward), 6) AS format_reward_func, round(avg(box_reward), 6) AS asymmetric_bbox_reward_func FROM scored",
    "reward_group_stats": f"WITH {SCORED} SELECT l_partkey AS prompt_id, count(*) AS n, round(avg(box_reward), 6) AS mean, round(stddev_pop(box_reward), 6) AS deviation FROM scored GROUP BY l_partkey",
    "benchmark_accuracy": f'WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (coverage::DOUBLE >= 0.9::DOUBLE AND "precision"::DOUBLE >= 0.7::DOUBLE) AS passed FROM scored',
    "crop_box": f"WITH {ZOOM} SELECT {KEYS}, {boxed(prefix='c')}, scale, pad_x, pad_y FROM ready",
    "project_box": f"WITH {ZOOM}, r AS (SELECT {KEYS}, " + projected(("200::FLOAT", "300::FLOAT", "800::FLOAT", "450::FLOAT")) + f" FROM ready) SELECT {KEYS}, {boxed(prefix='r')} FROM r",
    "zoom_verify": f"WITH {ZOOM}, r AS (SELECT *, " + projected(("mx0", "my0", "mx1", "my1")) + f""" FROM ready)
      SELECT {KEYS}, CASE WHEN px0 IS NULL THEN 'miss' ELSE 'too_small' END AS path, {boxed(prefix='h')} FROM zooms WHERE NOT zoom
      UNION ALL SELECT {KEYS}, CASE WHEN mx0 IS NULL THEN 'macro_fallback' ELSE 'refined' END, """
    + JOIN(f"CASE WHEN mx0 IS NULL THEN h{c} ELSE r{c} END" for c in CORNERS) + " FROM r",
    "zoom_verify_pixels": _zoom_pixels(),
    "holdout_split": f"""WITH {FRAMED}, placed AS (SELECT {KEYS}, row_number() OVER (ORDER BY md5({ROW_KEY} || '|17'), {KEYS}) - 1 AS pos, count(*) OVER () AS n FROM kept)
      SELECT {KEYS}, pos, CASE WHEN pos < greatest(1, floor(n * 0.01::DOUBLE)::BIGINT) THEN 'holdout' ELSE 'train' END AS part FROM placed""",
    "holdout_groups": f"""WITH {FRAME}, kept AS ({kept('frame')}), wanted AS (SELECT greatest(1, floor(count(*) * 0.05::DOUBLE)::BIGINT) AS w FROM kept),
      sized AS (SELECT image_path, md5('["' || image_path || '"]|17') AS digest, count(*) AS n FROM kept GROUP BY image_path),
      summed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
      sides AS (SELECT image_path, CASE WHEN before + n < w OR before = 0 OR (before < w AND before + n - w < w - before) THEN 'holdout' ELSE 'train' END AS part FROM summed, wanted)
      SELECT {KEYS}, image_path, part FROM kept JOIN sides USING (image_path)""",
    "page_image_join": f"WITH {CELLS} SELECT image_path, query, x0, y0, doc_id AS image FROM cells JOIN ordered ON page_ordinal = image_path::BIGINT",
    "page_lookup": f"""WITH {CELLS}, kept_cells AS ({kept('cells', 50)})
      SELECT image_path, query, x0, y0, md5(text) AS image FROM kept_cells JOIN ordered ON page_ordinal = image_path::BIGINT JOIN documents USING (doc_id)""",
    "zipped_rewards": f"""WITH {SCORED}, placed AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY l_orderkey) AS size FROM scored
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, completion))
      SELECT l_orderkey, count(*)::INTEGER AS n, sum(format_reward) AS total FROM placed WHERE nth <= greatest(size - 1, 1) GROUP BY l_orderkey""",
    "collated_batches": f"""WITH {CHATS}, longest AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS length FROM masked),
      padded AS (SELECT conv_id, batch_id, array_to_string(list_concat(input_ids, list_transform(range(0, length - len(input_ids)), lambda x: 0)), ',') AS i,
        array_to_string(list_concat(labels, list_transform(range(0, length - len(input_ids)), lambda x: -100)), ',') AS l FROM longest)
      SELECT batch_id, string_agg(i, ';' ORDER BY conv_id) AS input_ids, string_agg(l, ';' ORDER BY conv_id) AS labels FROM padded GROUP BY batch_id""",
    "build_datasets": f"""{BUILT} SELECT 'train' AS part, child, pick, pos, {PROMPT} AS prompt, {ANSWER} AS answer FROM train
      UNION ALL SELECT 'holdout', 0, NULL, pos, {PROMPT}, {ANSWER} FROM ui_rows WHERE pos < h""",
    "mixture_batches": f"""{BUILT}, texts AS (SELECT pos, {PROMPT} AS prompt, {ANSWER} AS answer FROM train),
      ids AS (SELECT *, list_transform(string_split(prompt || ' ' || answer, ' '), lambda w: length(w)::BIGINT) AS i, len(string_split(prompt, ' ')) AS p, pos // (16 * 32) AS w FROM texts),
      cuts AS (SELECT *, (row_number() OVER (PARTITION BY w ORDER BY len(i), pos) - 1) // 16 AS c FROM ids),
      marked AS (SELECT *, count(*) OVER (PARTITION BY w, c) = 16 AS whole, md5(w || '|' || c || '|17') AS digest FROM cuts),
      dealt AS (SELECT *, w * 32 + dense_rank() OVER (PARTITION BY w ORDER BY whole DESC, digest, c) - 1 AS batch_id FROM marked),
      longest AS (SELECT *, max(len(i)) OVER (PARTITION BY batch_id) AS length FROM dealt),
      labelled AS (SELECT *, array_to_string(list_concat(list_transform(i, lambda x, k: CASE WHEN k <= p THEN -100 ELSE x END), list_transform(range(0, length - len(i)), lambda x: -100)), ',') AS labels FROM longest)
      SELECT batch_id, (batch_id % 4)::INTEGER AS rank, batch_id // 4 AS step, sum(length - len(i))::BIGINT AS padding, count(*)::INTEGER AS n, any_value(length)::INTEGER AS length,
        string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, arg_max(labels, pos) AS last_labels FROM labelled GROUP BY batch_id""",
    "mix_counts": f"WITH {MIX_A}, {mixed(f'SELECT DISTINCT row_key FROM ({UI_CHILD})', f'SELECT row_key FROM ({CELL_CHILD})')} SELECT child, count(*) AS n, count(DISTINCT row_key) AS rows, max(pick) AS last_pick FROM mixed GROUP BY child",
    "mixed_rows": f"""WITH {MIX_A}, {mixed(f'SELECT DISTINCT row_key FROM ({UI_CHILD})', f'SELECT row_key FROM ({CELL_CHILD})')},
      rows AS (SELECT DISTINCT 0 AS child, row_key, image_path, query, x0, y0, x1, y1, img_w, img_h FROM ({UI_CHILD})
        UNION ALL SELECT 1, row_key, image_path, query, x0, y0, x1, y1, img_w, img_h FROM ({CELL_CHILD}))
      SELECT child, pick, pos, image_path, query, x0, y0, x1, y1, img_w, img_h FROM mixed JOIN rows USING (child, row_key)""",
    "mix_index": f"WITH {FRAMED}, " + mixed(f"SELECT {ROW_KEY} AS row_key FROM kept", "SELECT CAST(doc_id AS VARCHAR) AS row_key FROM documents WHERE lang = 'en'") + " SELECT pos, child, row_key, pick FROM mixed",
    "rescaled_pages": f"WITH {PAGES} SELECT count(*) FILTER (rescaled) AS rescaled, count(*) AS pages FROM scales",
    "pages_by_predicate": "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 14 = 0",
    "ui_corpus_files": f"WITH {FRAME} SELECT 'd/' || image_path || '.png' AS image_path, query, x0, y0, x1, y1, img_w, img_h FROM frame",
    "cell_corpus_files": f"WITH {CELLS} SELECT * FROM cells",
    "cached_frame": f"WITH {FRAME} SELECT * FROM frame",
    "build_alone": f"""WITH {FRAMED}, placed AS (SELECT *, row_number() OVER (ORDER BY md5({ROW_KEY} || '|17'), {KEYS}) - 1 AS pos, count(*) OVER () AS n FROM framed)
      SELECT {KEYS}, {PROMPT} AS content, {boxed('_f')} FROM placed WHERE pos >= greatest(1, floor(n * 0.01::DOUBLE)::BIGINT)""",
    "cell_sft_rows": f"""WITH {CELLS}, kept_cells AS ({kept('cells', 50)}), sized AS (SELECT *, {params('img_w', 'img_h')} FROM kept_cells), padded AS (SELECT *, {PADS} FROM sized),
      framed AS (SELECT *, {", ".join(f"{to_frame(c)} AS {c}_f" for c in CORNERS)} FROM padded), {ROUNDED} SELECT image_path, {PROMPT} AS prompt, {ANSWER} AS answer FROM rounded""",
    "collated_pixels": f"""WITH {CHATS}, longest AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS length, list_transform(input_ids[1:3], lambda x: x || ',' || (x * 2)) AS pixels FROM masked),
      padded AS (SELECT *, array_to_string(list_concat(list_transform(input_ids, lambda x: 1), list_transform(range(0, length - len(input_ids)), lambda x: 0)), ',') AS a,
        array_to_string(list_concat(CASE WHEN conv_id % 2 = 0 THEN list_transform(input_ids, lambda x: x % 2) ELSE []::BIGINT[] END,
          list_transform(range(0, length - CASE WHEN conv_id % 2 = 0 THEN len(input_ids) ELSE 0 END), lambda x: 0)), ',') AS m FROM longest)
      SELECT batch_id, string_agg(a, ';' ORDER BY conv_id) AS attention_mask, string_agg(m, ';' ORDER BY conv_id) AS mm_token_type_ids,
        string_agg(array_to_string(pixels, ';'), ';' ORDER BY conv_id) AS pixel_values, string_agg('1,' || len(pixels), ';' ORDER BY conv_id) AS image_grid_thw FROM padded GROUP BY batch_id""",
    "image_letterbox_pixels": f"""WITH {PLAIN_IMAGES}, {SMALL_FRAMES}, grid AS (SELECT x, y FROM range(64) t(x), range(48) s(y))
      SELECT id, x::INTEGER AS x, y::INTEGER AS y, CASE WHEN shown THEN r ELSE 0 END AS r, CASE WHEN shown THEN g ELSE 0 END AS g, CASE WHEN shown THEN b ELSE 0 END AS b
      FROM (SELECT *, x >= pad_x AND x < pad_x + content_w AND y >= pad_y AND y < pad_y + content_h AS shown FROM fitted, grid)""",
    "image_crop_pixels": f"""WITH boxes AS (SELECT s_suppkey AS id, s_suppkey % 2 AS k, s_suppkey AS i FROM supplier),
      cornered AS (SELECT id, CASE k WHEN 0 THEN 200 ELSE 5 END AS r, CASE k WHEN 0 THEN i % 90 ELSE 250 END::INTEGER AS g, CASE k WHEN 0 THEN 30 ELSE i % 70 END::INTEGER AS b,
        CASE k WHEN 0 THEN 10 ELSE 45 END::DOUBLE AS x0, CASE k WHEN 0 THEN 8 ELSE 10 END::DOUBLE AS y0, CASE k WHEN 0 THEN 30 ELSE 60 END::DOUBLE AS x1, CASE k WHEN 0 THEN 20 ELSE 44 END::DOUBLE AS y1 FROM boxes),
      plain AS (SELECT id, r, g, b, least(64, ceil(x1 + (x1 - x0) * 0.15::DOUBLE))::INTEGER - greatest(0, floor(x0 - (x1 - x0) * 0.15::DOUBLE))::INTEGER AS w,
        least(48, ceil(y1 + (y1 - y0) * 0.15::DOUBLE))::INTEGER - greatest(0, floor(y0 - (y1 - y0) * 0.15::DOUBLE))::INTEGER AS h FROM cornered),
      {SMALL_FRAMES}, grid AS (SELECT x, y FROM range(64) t(x), range(48) s(y))
      SELECT id, x::INTEGER AS x, y::INTEGER AS y, CASE WHEN shown THEN r ELSE 0 END AS r, CASE WHEN shown THEN g ELSE 0 END AS g, CASE WHEN shown THEN b ELSE 0 END AS b
      FROM (SELECT *, x >= pad_x AND x < pad_x + content_w AND y >= pad_y AND y < pad_y + content_h AS shown FROM fitted, grid)""",
    "rows_with_pixels": f"""WITH {UI}, {PLAIN_IMAGES}, {SMALL_FRAMES}, scaled AS (SELECT {KEYS}, fitted.*, """
    + JOIN(f"{clamp('n' + c, '0.0::DOUBLE', '1.0::DOUBLE')} * {'w' if c[0] == 'x' else 'h'}::DOUBLE AS {c}" for c in CORNERS)
    + " FROM ui JOIN fitted ON id = l_suppkey) SELECT " + KEYS + ", " + JOIN(f"{to_frame(c)} AS {c}_f" for c in CORNERS)
    + ", (64 * 48 * 3)::INTEGER AS n_bytes, printf('%02X%02X%02X', r, g, b) AS middle FROM scaled",
    "image_headers": "SELECT p_partkey, (p_partkey % 5000 + 1)::INTEGER AS img_w, p_size::INTEGER AS img_h FROM part",
    "image_folder_sizes": f"""WITH {PLAIN_IMAGES}, named AS (SELECT plain.*, s_nationkey, ['', '_', '.h'][(id % 3 + 1)::INTEGER] || id || '.png' AS basename FROM plain JOIN supplier ON s_suppkey = id)
      SELECT 's' AS source, s_nationkey || '/' || basename AS rel_path, basename, w AS img_w, h AS img_h FROM named""",
    "zip_scan": f"""WITH {PLAIN_IMAGES} SELECT s_nationkey::VARCHAR AS archive, 'd/' || id || '.png' AS name, w AS img_w, h AS img_h FROM plain JOIN supplier ON s_suppkey = id
      WHERE id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 45)""",
    "archive_ingest": f"""WITH {PLAIN_IMAGES} SELECT s_nationkey::VARCHAR AS source, 'd/' || id || '.png' AS rel_path, w AS img_w, h AS img_h, true AS whole, true AS listed
      FROM plain JOIN supplier ON s_suppkey = id""",
    "metrics_table": f"""WITH {SCORED}, counters AS (SELECT count(*)::DOUBLE AS elements, (count(*) FILTER (x1 - x0 < 5 OR y1 - y0 < 5))::DOUBLE AS small, max(x1) AS widest FROM frame),
      means AS (SELECT l_partkey % 16 AS step, avg(format_reward) AS f, avg(box_reward) AS b FROM scored GROUP BY 1)
      SELECT 0::BIGINT AS step, 'elements' AS name, round(elements, 6) AS value FROM counters UNION ALL SELECT 0, 'small', round(small, 6) FROM counters UNION ALL SELECT 0, 'widest', round(widest, 6) FROM counters
      UNION ALL SELECT step, 'rewards/format_reward_func/mean', round(f, 6) FROM means UNION ALL SELECT step, 'rewards/asymmetric_bbox_reward_func/mean', round(b, 6) FROM means""",
}
