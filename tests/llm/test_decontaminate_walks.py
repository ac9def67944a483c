"""Walks of all seeds take their steps together, with the keys of one walk after the other."""
import numpy as np
import pytest

from shopfloor.llm import decontaminate as dec


def _plain(flat, starts, m, first, last):
    out = np.zeros((len(starts), (last - first) * dec.SAMPLES), np.uint64)
    mask = (1 << 64) - 1
    for n, start in enumerate(starts.tolist()):
        for walk in range(first, last):
            place = np.floor(dec.PLACES[walk] * (2 * m)).astype(int)
            at = 0
            for step in range(2 * m):
                symbol = int(flat[start + at]) if at < m else -1
                for sample, bit in np.argwhere(place == step).tolist():
                    key = dec._scatter(np.array([(symbol + 1) & mask], np.uint64), 977 * bit + 13)
                    out[n, (walk - first) * dec.SAMPLES + sample] += key[0]
                draw = dec._scatter(np.array([(symbol + (step << 32)) & mask], np.uint64), int(dec.WALK_SEEDS[walk]))
                at += int(at < m and (int(draw[0]) >> 60) & 1)
    return out


@pytest.mark.parametrize(("m", "first", "last"), [(1, 0, 4), (5, 0, 2), (9, 3, 6), (4, 2, 2)])
def test_keys_equal_single_walks(m, first, last):
    flat = np.random.default_rng(m).integers(0, 9, 40)
    starts = np.array([0, 3, 17, 30])
    assert np.array_equal(dec.walk_keys(flat, starts, m, first, last), _plain(flat, starts, m, first, last))
    assert dec.walk_keys(flat, starts[:0], m, first, last).shape == (0, (last - first) * dec.SAMPLES)


def test_calls_do_not_grow_with_the_walks(monkeypatch):
    calls, plain = [], dec._scatter
    monkeypatch.setattr(dec, "_scatter", lambda x, salt: calls.append(1) or plain(x, salt))
    dec.walk_keys(np.arange(300), np.arange(100), 64, 0, dec.MOST_WALKS)
    assert len(calls) <= 2 * 2 * 64
