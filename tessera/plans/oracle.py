"""Pieces of the SQL counterparts: the derived picture and its colours as CTEs."""

from __future__ import annotations

PIXEL = """pixel AS (
  SELECT image_id, pixel_id, x, y, zone, noise,
    least(255, greatest(0, CASE zone WHEN 0 THEN 200 WHEN 1 THEN 40 WHEN 2 THEN 120 ELSE 240 END + 2*noise - 8)) AS r,
    least(255, greatest(0, CASE zone WHEN 0 THEN 40 WHEN 1 THEN 60 WHEN 2 THEN 180 ELSE 235 END + 2*noise - 8)) AS g,
    least(255, greatest(0, CASE zone WHEN 0 THEN 40 WHEN 1 THEN 200 WHEN 2 THEN 90 ELSE 225 END + 2*noise - 8)) AS b,
    CAST(CASE WHEN noise = 8 AND zone = 3 THEN CASE WHEN x % 2 = 0 THEN 0 ELSE 128 END ELSE 255 END AS BIGINT) AS a
  FROM (SELECT *, ((x // 12) * 3 + (y // 9) * 5 + image_id) % 4 AS zone, (x * 7 + y * 13 + user_id) % 9 AS noise
    FROM (SELECT event_id // 4000 AS image_id, event_id AS pixel_id, event_id % 100 AS x, event_id // 100 % 40 AS y, user_id FROM events)))"""

FRAME = "frame AS (SELECT image_id, 100 AS w, max(y) + 1 AS high FROM pixel GROUP BY image_id)"


def linear(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END)"


def lab(source: str = "pixel", half: str = "app", name: str = "lab") -> str:
    """CTEs that add l, ok_a, ok_b, c, h (degrees, or radians for the engine half)."""
    last = "0.8086757993" if half == "app" else "0.8086757660"
    hue = "CASE WHEN atan2(ok_b, ok_a) < 0 THEN degrees(atan2(ok_b, ok_a)) + 360 ELSE degrees(atan2(ok_b, ok_a)) END" if half == "app" else "atan2(ok_b, ok_a)"
    return f"""{name}_lin AS (SELECT *, {linear('r / 255.0')} AS rl, {linear('g / 255.0')} AS gl, {linear('b / 255.0')} AS bl FROM {source}),
{name}_lms AS (SELECT *, cbrt(0.4122214708*rl + 0.5363325363*gl + 0.0514459929*bl) AS m1, cbrt(0.2119034982*rl + 0.6806995451*gl + 0.1073969566*bl) AS m2, cbrt(0.0883024619*rl + 0.2817188376*gl + 0.6299787005*bl) AS m3 FROM {name}_lin),
{name}_lab AS (SELECT *, 0.2104542553*m1 + 0.7936177850*m2 - 0.0040720468*m3 AS l, 1.9779984951*m1 - 2.4285922050*m2 + 0.4505937099*m3 AS ok_a, 0.0259040371*m1 + 0.7827717662*m2 - {last}*m3 AS ok_b FROM {name}_lms),
{name} AS (SELECT *, sqrt(ok_a*ok_a + ok_b*ok_b) AS c, {hue} AS h FROM {name}_lab)"""


def claim_score(entry) -> str:
    al, ac, ah = entry.lch()
    th, tc, tl = (max(1e-6, t) for t in entry.tolerances())
    hw, cw, lw = entry.weights
    dl, dc = f"abs(l - {al!r})", f"abs(c - {ac!r})"
    dh = f"least(abs(h - {ah!r}) % 360, 360 - abs(h - {ah!r}) % 360)"
    eff = f"({hw!r} * least(1.0, greatest(0.0, c / 0.05)))"
    hue = ac >= 0.02
    total = f"{lw!r} * pow({dl} / {tl!r}, 2) + {cw!r} * pow({dc} / {tc!r}, 2)" + (f" + CASE WHEN {eff} > 1e-4 THEN {eff} * pow({dh} / {th!r}, 2) ELSE 0 END" if hue else "")
    weight = f"{lw + cw!r}" + (f" + CASE WHEN {eff} > 1e-4 THEN {eff} ELSE 0 END" if hue else "")
    inside = f"{dl} <= {tl!r} AND {dc} <= {tc!r}" + (f" AND ({eff} <= 1e-4 OR {dh} <= {th!r})" if hue else "")
    return f"CASE WHEN {inside} THEN ({total}) / ({weight}) END"


def claim_ctes(palette: list, source: str = "lab", name: str = "claimed") -> str:
    """The fold over entries as a chain of CTEs; ends in name(…, winner)."""
    pinned = [e for e in palette if e.pinned]
    scores = ", ".join(f"{claim_score(e)} AS s{k}" for k, e in enumerate(pinned))
    out = [f"{name}_s AS MATERIALIZED (SELECT *, {scores} FROM {source})", f"{name}_0 AS (SELECT *, CASE WHEN s0 IS NULL THEN -1 ELSE 0 END AS w0, coalesce(s0, CAST('inf' AS DOUBLE)) AS b0 FROM {name}_s)"]
    for k in range(1, len(pinned)):
        out.append(f"{name}_{k} AS (SELECT *, CASE WHEN s{k} < b{k - 1} - 1e-6 THEN {k} ELSE w{k - 1} END AS w{k}, CASE WHEN s{k} < b{k - 1} - 1e-6 THEN s{k} ELSE b{k - 1} END AS b{k} FROM {name}_{k - 1})")
    last = len(pinned) - 1
    return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT *, w{last} AS winner FROM {name}_{last})"])


def nearest(centres: list[tuple[float, float, float]]) -> str:
    """Index of the nearest centre, lowest on ties."""
    d = [f"(pow(l - {l!r}, 2) + pow(ok_a - ({a!r}), 2) + pow(ok_b - ({b!r}), 2))" for l, a, b in centres]
    low = "least(" + ", ".join(d) + ")"
    return "CASE " + " ".join(f"WHEN {x} = {low} THEN {k}" for k, x in enumerate(d)) + " END"


def owner_ctes(palette: list) -> str:
    pinned, auto = [e for e in palette if e.pinned], [e for e in palette if not e.pinned]
    by_winner = " ".join(f"WHEN winner = {k} THEN '{e.id}'" for k, e in enumerate(pinned))
    by_near = " ".join(f"WHEN near = {k} THEN '{e.id}'" for k, e in enumerate(auto))
    return f"""{claim_ctes(palette)},
near AS (SELECT *, {nearest([e.lab() for e in auto])} AS near FROM claimed),
owned AS (SELECT *, CASE {by_winner} WHEN a / 255.0 >= 0.05 THEN CASE {by_near} END END AS owner FROM near)"""


def reachable(mask: str) -> str:
    """comp(image_id, x, y, component) of a CTE mask(image_id, x, y): transitive closure over 4-neighbours."""
    return f"""walk(image_id, x, y, sx, sy) AS (
  SELECT image_id, x, y, x, y FROM {mask}
  UNION
  SELECT m.image_id, m.x, m.y, walk.sx, walk.sy FROM walk JOIN {mask} m ON m.image_id = walk.image_id AND abs(m.x - walk.x) + abs(m.y - walk.y) = 1 AND m.x BETWEEN walk.x - 1 AND walk.x + 1 AND m.y BETWEEN walk.y - 1 AND walk.y + 1),
comp AS (SELECT image_id, x, y, min(sy * 100 + sx) AS component FROM walk GROUP BY image_id, x, y)"""


def disc_values(radius: float) -> str:
    from tessera.operators.masks import disc

    return "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in disc(radius)) + ") AS o(dx, dy)"
