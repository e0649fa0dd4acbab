import pytest

from volquery.config import ConfigError, JobConfig

SMALL = {"patch": (16, 16, 16), "overlap": 4, "trim_voxels": 2, "block": (32, 32, 32)}


def test_defaults():
    cfg = JobConfig()
    assert (cfg.patch, cfg.block, cfg.overlap, cfg.batch_size) == ((64, 64, 64), (256, 256, 256), 10, 32)
    assert cfg.halo == 5 and cfg.normalize == "percentile" and cfg.clip_bounds is None
    assert cfg.output_denormalize and cfg.stride == (54, 54, 54)


@pytest.mark.parametrize("patch, expected", [((64, 64, 64), 8), ((16, 16, 16), 2), ((6, 6, 6), 1)])
def test_blend_halo_follows_the_patch(patch, expected):
    assert JobConfig(patch=patch, overlap=2, block=(64, 64, 64), seam_mode="blend", trim_voxels=None).halo == expected


@pytest.mark.parametrize(
    "bad",
    [
        {"patch": (0, 16, 16)}, {"block": (32, 32)}, {"overlap": 16}, {"overlap": -1}, {"block": (8, 32, 32)}, {"seam_mode": "average"}, {"trim_voxels": None}, {"trim_voxels": -1},
        {"overlap": 3}, {"seam_mode": "blend", "min_blend_weight": 0.0}, {"seam_mode": "blend", "min_blend_weight": 1.5}, {"seam_mode": "blend", "overlap": 0, "trim_voxels": None}, {"halo": -1},
        {"norm_lower": 50.0, "norm_upper": 50.0}, {"norm_upper": 101.0}, {"normalize": "global", "norm_lower": 9.0, "norm_upper": 1.0}, {"clip_norm": (1.0, 0.0)}, {"clip_norm": (1.0,)},
        {"eps": 0.0}, {"batch_size": 0}, {"normalize": "minmax"},
    ],
)
def test_rejects(bad):
    with pytest.raises(ConfigError):
        JobConfig(**(SMALL | bad))


def test_halo_is_raised_to_the_trim():
    with pytest.warns(RuntimeWarning, match="raised"):
        assert JobConfig(**SMALL, halo=1).halo == 2


@pytest.mark.parametrize("more, text", [({"trim_voxels": 0, "halo": 0}, "halo"), ({"normalize": True}, "names no method"), ({"seam_mode": "blend"}, "no effect")])
def test_warns(more, text):
    with pytest.warns(RuntimeWarning, match=text):
        JobConfig(**(SMALL | more))


@pytest.mark.parametrize("clip, bounds", [(False, None), (True, (0.0, 1.0)), ((0, 5), (0, 5))])
def test_clip_bounds(clip, bounds):
    assert JobConfig(**SMALL, clip_norm=clip).clip_bounds == bounds
