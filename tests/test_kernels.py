from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismal.functions import kernels as K


@pytest.mark.parametrize("rgb,expected", [((0, 0, 0), 0), ((255, 255, 255), 1), ((255, 0, 0), 0.49092), ((0, 255, 0), 0.83126), ((0, 0, 255), 0.26077)])
def test_brightness_of_plain_colors(rgb, expected):
    b = K.brightness(np.full((8, 8, 3), rgb, dtype=np.uint8))
    assert abs(b["brightness"] - expected) < 1e-5 and abs(b["brightness_perc_5"] - expected) < 1e-5


def test_alpha_mean_uses_first_band():
    a = np.zeros((4, 4, 4), dtype=np.uint8)
    a[:, :, 0], a[:, :, 3] = 102, 255
    assert K.brightness(a)["brightness"] == pytest.approx(0.4)


def test_entropy():
    assert K.entropy(np.zeros((5, 5), np.uint8)) == 0
    assert K.entropy(np.arange(256, dtype=np.uint8).reshape(16, 16)) == pytest.approx(8)
    two = np.zeros((2, 2, 3), np.uint8)
    two[:, :, 1] = 0
    two[:, :, 2] = 9
    assert K.entropy(two) == pytest.approx(np.log2(3))  # each band's histogram counts on its own


def test_black_is_not_sharp_and_edges_keep_their_border():
    assert K.blurriness(np.zeros((200, 200, 3), np.uint8))["blurriness"] == 0
    flat = np.full((5, 5), 200, np.uint8)
    e = K.edges(flat)
    assert (e[0] == 200).all() and (e[1:-1, 1:-1] == 0).all()


@pytest.mark.parametrize("kind", ["bicubic", "lanczos"])
def test_resize_keeps_flat_images_and_shape(kind):
    flat = np.full((37, 91, 3), 77, np.uint8)
    out = K.resize(flat, 20, 64, kind)
    assert out.shape == (64, 20, 3) and (out == 77).all()
    assert (K.resize(np.arange(64, dtype=np.uint8).reshape(8, 8), 8, 8, kind) == np.arange(64).reshape(8, 8)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(9, 70), st.integers(9, 70), st.sampled_from(sorted(K.HASHES)))
def test_hashes_repeat_and_have_their_length(seed, h, w, kind):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    a = K.HASHES[kind](x, 8)
    assert a == K.HASHES[kind](x.copy(), 8)
    assert len(a) == (14 * 8 // 4 if kind == "chash" else 16)


def test_perceptual_hash_survives_a_little_noise():
    y, x = np.mgrid[0:128, 0:128]
    a = (127 + 100 * np.sin(x / 17.0) * np.cos(y / 23.0)).astype(np.uint8)
    b = a.copy()
    b[5, 5] ^= 1
    assert K.phash(a, 8) == K.phash(b, 8) and K.whash(a, 8) == K.whash(b, 8)
    assert K.phash(a, 8) != K.phash(a.T.copy(), 8)


def test_colour_hash_of_black():
    assert K.chash(np.zeros((9, 9, 3), np.uint8), 3) == K.chash(np.zeros((20, 20, 3), np.uint8), 3)


def test_pixels_turns_bgr_around():
    assert K.pixels(1, 1, 3, bytes([1, 2, 3])).tolist() == [[[3, 2, 1]]]
    assert K.mode(np.zeros((2, 2, 4))) == "RGBA" and K.mode(np.zeros((2, 2))) == "L"
