"""Image steps against plain loops, and registration of known shifts."""

import numpy as np
import pytest

from cellweave.operators import imaging as I


def frame(spark, images, round_=1):
    rows = [(f, round_, 0, 0, *img.shape, img.ravel().tolist()) for f, img in enumerate(images)]
    return spark.createDataFrame(rows, "fov long, round int, channel int, z int, height int, width int, data array<double>")


def read(df):
    return {r.fov: np.array(r.data).reshape(r.height, r.width) for r in df.collect()}


def test_steps(spark):
    img = np.random.default_rng(0).random((12, 15)) * 100
    pad = np.pad(img, 1, mode="symmetric")
    want = np.array([[np.median(pad[i : i + 3, j : j + 3]) for j in range(15)] for i in range(12)])
    assert np.allclose(I.median(img), want)
    assert np.allclose(I.gaussian(np.full((9, 9), 3.0), 1.5), 3.0) and I.gaussian(img, 1.0).std() < img.std()
    assert I.min_max(img).min() == 0 and I.min_max(img).max() == 255 and not I.min_max(np.ones((3, 3))).any()
    assert (I.difference_of_gaussians(img) >= 0).all() and (I.top_hat(img) >= 0).all()
    out = I.equalise(img)
    assert out.shape == img.shape and 0 <= out.min() and out.max() <= 1 + 1e-9
    got = read(I.process(frame(spark, [img]), [("gamma", {"value": 2.0}), ("min_max", {"top": 1.0})]))[0]
    assert np.allclose(got, (img**2 - (img**2).min()) / ((img**2).max() - (img**2).min()))
    with pytest.raises(ValueError):
        I.process(frame(spark, [img]), [("sharpen", {})])
    with pytest.raises(ValueError):
        I.median(img, 4)


def test_registration_and_matching(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((32, 32)) for _ in range(3)]
    moved = [np.roll(img, (3, -5), (0, 1)) for img in images]
    found = I.shifts(frame(spark, images), frame(spark, moved, 2)).collect()
    assert all((r.dy, r.dx) == (-3, 5) for r in found) and len(found) == 3
    by = spark.createDataFrame([(f, 1, 1.0, -2.5) for f in range(3)], "fov long, round int, dy double, dx double")
    out = read(I.shifted(frame(spark, images), by))[0]
    inner = 0.5 * images[0][:-1, 2:-1] + 0.5 * images[0][:-1, 3:]
    assert np.allclose(out[1:, :-3], inner) and not out[0].any() and not out[:, -2:].any()
    reference = frame(spark, [img * 7 + 1 for img in images]).where("fov < 2").select("fov", "channel", "z", "data")
    got = read(I.matched(frame(spark, images), reference))
    assert np.allclose(got[0], images[0] * 7 + 1) and np.allclose(got[2], images[2])
