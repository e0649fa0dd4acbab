"""SQL texts of the catalogue, written from the geometry rules and not from the DataFrame code."""

from __future__ import annotations

#: Voxels ``z, y, x, p`` of the fixture volumes.
VOLUMES = {
    "events": "SELECT event_id // 100 AS z, (event_id // 10) % 10 AS y, event_id % 10 AS x, value AS p FROM events",
    "vectors": "SELECT vec_id AS z, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, embedding[i]::DOUBLE AS p FROM embeddings, range(1, 65) t(i)",
    "sizes": "SELECT p_partkey // 100 AS z, (p_partkey // 10) % 10 AS y, p_partkey % 10 AS x, p_size::DOUBLE AS p FROM part",
    "prices": "SELECT p_partkey // 100 AS z, (p_partkey // 10) % 10 AS y, p_partkey % 10 AS x, p_retailprice AS p FROM part",
    "ragged": "SELECT event_id // 40 AS z, (event_id // 5) % 8 AS y, event_id % 5 AS x, value AS p FROM events",
}
EXTENTS = {
    "events": ("(SELECT max(event_id) // 100 + 1 FROM events)", "10", "10"),
    "vectors": ("(SELECT max(vec_id) + 1 FROM embeddings)", "8", "8"),
    "sizes": ("(SELECT max(p_partkey) // 100 + 1 FROM part)", "10", "10"),
    "prices": ("(SELECT max(p_partkey) // 100 + 1 FROM part)", "10", "10"),
    "ragged": ("(SELECT max(event_id) // 40 + 1 FROM events)", "8", "5"),
}


def axis(a: str, extent: str, block: int, patch: int, overlap: int, halo: int, trim: int, floor: float) -> str:
    """CTEs ``blk_a`` (blocks), ``pat_a`` (patches) and ``cov_a`` (coordinates in patches) of an axis."""
    stride = max(1, patch - overlap)
    return f"""
blk_{a} AS (SELECT k, k * {block} AS bs, least((k + 1) * {block}, n) AS be, greatest(k * {block} - {halo}, 0) AS lo, least(least((k + 1) * {block}, n) + {halo}, n) AS hi
  FROM (SELECT {extent} AS n), LATERAL (SELECT unnest(range(0, (n + {block - 1}) // {block})) AS k)),
pat_{a} AS (SELECT k, bs, be, lo, hi, hi - lo AS len, s, least(s + {patch}, hi - lo) - s AS v
  FROM (SELECT *, unnest(CASE WHEN hi - lo <= {patch} THEN [0] ELSE list_distinct(list_append(range(0, hi - lo - {patch} + 1, {stride}), hi - lo - {patch})) END) AS s FROM blk_{a})),
off_{a} AS (SELECT *, unnest(range(0, v)) AS j FROM pat_{a}),
cov_{a} AS (SELECT lo + s + j AS g, k, s, j, v, len, lo + s + j >= bs AND lo + s + j < be AS core,
    j >= CASE WHEN s = 0 THEN 0 ELSE {trim} END AND j < v - CASE WHEN s + v = len THEN 0 ELSE {trim} END AS keep,
    greatest({floor}, CASE WHEN j < least({overlap}, s) THEN 0.5 - 0.5 * cos(pi() * (j + 1) / (least({overlap}, s) + 1)) ELSE 1.0 END
      * CASE WHEN v - 1 - j < least({overlap}, len - s - v) THEN 0.5 - 0.5 * cos(pi() * (v - j) / (least({overlap}, len - s - v) + 1)) ELSE 1.0 END) AS w
  FROM off_{a})"""


def geometry(volume: str, block: tuple, patch: tuple, overlap: int, halo: int, trim: int = 0, floor: float = 1.0) -> str:
    parts = [axis(a, e, b, p, overlap, halo, trim, floor) for a, e, b, p in zip("zyx", EXTENTS[volume], block, patch)]
    return f"WITH vox AS ({VOLUMES[volume]})," + ",".join(parts)


#: Voxels in widened blocks.
WIDE = """,
wide AS (SELECT bz.k AS k_z, ky.k AS k_y, kx.k AS k_x, v.*, v.z >= bz.bs AND v.z < bz.be AND v.y >= ky.bs AND v.y < ky.be AND v.x >= kx.bs AND v.x < kx.be AS core
  FROM vox v, blk_z bz, blk_y ky, blk_x kx WHERE v.z >= bz.lo AND v.z < bz.hi AND v.y >= ky.lo AND v.y < ky.hi AND v.x >= kx.lo AND v.x < kx.hi)"""


def stats(lower: float, upper: float) -> str:
    return f""",
st AS (SELECT k_z, k_y, k_x, quantile_cont(p, {lower / 100.0!r}) AS mn, quantile_cont(p, {upper / 100.0!r}) AS mx, count(*) AS n_voxels FROM wide GROUP BY ALL)"""


#: Every voxel in every patch, with block statistics.
COVER = """,
inc AS (SELECT v.z, v.y, v.x, v.p, cz.k AS k_z, cy.k AS k_y, cx.k AS k_x, cz.s AS s_z, cy.s AS s_y, cx.s AS s_x,
    cz.core AND cy.core AND cx.core AS core, cz.keep AND cy.keep AND cx.keep AS keep, cz.w * cy.w * cx.w AS w
  FROM vox v JOIN cov_z cz ON v.z = cz.g JOIN cov_y cy ON v.y = cy.g JOIN cov_x cx ON v.x = cx.g)"""


def model_rows(q: str, model: str, size: int, scale: str, low: str, joined: bool, denormalize: bool = True) -> str:
    """``pred``: incidences with the model's value ``r``; ``q`` normalises ``p``."""
    source = "inc JOIN st USING (k_z, k_y, k_x)" if joined else "inc"
    value = {"identity": "q", "affine": "q * 0.5 + 0.25", "demean": f"q - sum(q) OVER (PARTITION BY k_z, k_y, k_x, s_z, s_y, s_x) / {float(size)}"}[model]
    back = f"({value}) * {scale} + {low}" if denormalize else value
    return f""",
nrm AS (SELECT *, {q} AS q FROM {source}),
pred AS (SELECT *, {back} AS r FROM nrm)"""


TRIM = """
SELECT z, y, x, round(arg_max(r, [s_z, s_y, s_x]) + 1.047e-8, 6) + 0.0 AS v FROM pred WHERE core AND keep GROUP BY z, y, x"""


def blend(eps: float) -> str:
    return f"""
SELECT z, y, x, round(sum(r * w) / greatest(sum(w), {eps!r}) + 1.047e-8, 6) + 0.0 AS v FROM pred WHERE core GROUP BY z, y, x"""
