import numpy as np
import pytest
from pyspark.sql import functions as F

from loom.functions import noise, settings
from loom.operators import labels as lb
from loom.operators import stats


def test_settings_round_trip(tmp_path):
    s = {"opt": {"lr": 0.1, "deep": {"x": [1, 2]}}, "name": "a"}
    settings.dump(s, str(tmp_path / "d" / "s.json"))
    assert settings.load(str(tmp_path / "d" / "s.json")) == s
    assert settings.flat(s) == {"opt.lr": 0.1, "opt.deep.x": [1, 2], "name": "a"} and settings.nested(settings.flat(s)) == s
    (tmp_path / "t.toml").write_text("[opt]\nlr = 0.5\n")
    assert settings.merged(s, settings.load(str(tmp_path / "t.toml")), {"name": "b"}) == {"opt": {"lr": 0.5, "deep": {"x": [1, 2]}}, "name": "b"}
    with pytest.raises(ValueError, match="unknown"):
        settings.merged(s, {"opt": {"l": 1}})
    with pytest.raises(ValueError):
        settings.load("x.ini")


def test_flat_columns(spark):
    df = spark.range(2).select("id", F.struct(F.lit(1).alias("x"), F.struct(F.lit("q").alias("z")).alias("y")).alias("s"))
    assert settings.flat_columns(df).columns == ["id", "s.x", "s.y.z"]


def test_noise():
    x = noise.perlin((3, 33, 40), seed=1)
    assert x.shape == (3, 33, 40) and np.allclose(x.mean((1, 2)), 0) and np.allclose(x.std((1, 2), ddof=1), 1, atol=1e-6)
    assert np.array_equal(x, noise.perlin((3, 33, 40), seed=1)) and not np.array_equal(x[0], x[1])
    assert np.abs(np.diff(x, axis=2)).mean() < 0.5 * np.abs(x[:, :, 1:] - x[:, ::-1, 1:]).mean()  # smooth
    sizes = {k: len(noise.octaves(256, 256, k)) for k in (0, 1, 2, 3, 4, 5)}
    assert sizes == {0: 1, 1: 2, 2: 1, 3: 2, 4: 2, 5: 3}
    a = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(noise.enlarged(a, 3, 4), a) and noise.enlarged(a, 6, 8).shape == (6, 8)


def test_text_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one x\n\n  two y \n")
    (tmp_path / "b.txt").write_text("f1\tcat\textra\nf2\tdog\n\n")
    a, b = (spark.read.text(str(tmp_path / n)) for n in ("a.txt", "b.txt"))
    assert [r.name for r in lb.name_list(a).collect()] == ["one x", "two y"]
    assert [r.name for r in lb.first_fields(b, "\t").collect()] == ["f1", "f2"]
    assert [tuple(r) for r in lb.annotations(b).collect()] == [("f1", "cat"), ("f2", "dog")]


def test_fresh_blocks_are_orthogonal():
    a = stats.fresh_block(None, 3, 10, 1)
    b = stats.fresh_block(a, 4, 10, 2)
    assert np.allclose(a @ a.T, np.eye(3)) and np.allclose(b @ b.T, np.eye(4)) and np.allclose(a @ b.T, 0)


def test_a_setting_is_a_value_or_has_settings():
    with pytest.raises(ValueError, match="'a'"):
        settings.nested({"a": 1, "a.b": 2})
    assert settings.nested({"a.b": 1, "ab": 2}) == {"a": {"b": 1}, "ab": 2}
