"""Attributes of many image groups against the plain reader of one."""

import json
import os

import numpy as np

from volquery.operators.metadata import pyramid_spec
from volquery.sources.image_groups import group_documents, image_levels


def document(rng, form, levels):
    scales = [[1.0, 1.0, *(float(x) * 2.0**i for x in rng.choice([0.5, 1.0, 1.24], 3))] for i in range(levels)]
    inner = {"multiscales": [{"name": "n", "datasets": [{"path": str(i), "coordinateTransformations": [{"type": "translation", "translation": [0.0] * 5}, {"type": "scale", "scale": s}]} for i, s in enumerate(scales)]}]}
    return {"zarr_format": 3, "attributes": {"ome": inner}} if form == "zarr.json" else inner


def test_thousands_of_groups(spark, tmp_path):
    rng = np.random.default_rng(1)
    wanted, reasons, paths = {}, {}, []
    for g in range(2000):
        root = f"{tmp_path}/g{g}"
        os.makedirs(root)
        paths.append((root,))
        form, levels = ("zarr.json", ".zattrs")[g % 2], 1 + g % 4
        body = document(rng, form, levels)
        if g % 50 == 3:
            inner = body if form == ".zattrs" else body["attributes"]["ome"]
            inner["multiscales"][0]["datasets"][-1]["coordinateTransformations"] = []
        text = "{ no json" if g % 50 == 7 else "[]" if g % 50 == 9 else json.dumps(body)
        if g % 50 == 11:
            reasons[root] = "no attributes"
            continue
        with open(f"{root}/{form}", "w") as file:
            file.write(text)
        spec = None if g % 50 in (7, 9) else pyramid_spec(body)
        if spec is None:
            reasons[root] = "not JSON" if g % 50 == 7 else "no image" if g % 50 == 9 else "fewer than two levels" if levels < 2 else "a level without scale"
        else:
            wanted[root] = spec
    rows = image_levels(group_documents(spark.createDataFrame(paths, "path string").repartition(8))).collect()
    assert {r.path: r.reason for r in rows if r.reason} == reasons and len([r for r in rows if r.reason]) == len(reasons)
    found = {}
    for r in sorted((r for r in rows if not r.reason), key=lambda r: (r.path, r.level)):
        found.setdefault(r.path, []).append(r)
    assert found.keys() == wanted.keys()
    for path, spec in wanted.items():
        assert len(found[path]) == spec["levels"] and tuple(found[path][0].scale) == spec["voxel"]
        assert [tuple(r.factor) for r in found[path][1:]] == spec["factors"] and [r.dataset for r in found[path]] == [str(i) for i in range(spec["levels"])]
