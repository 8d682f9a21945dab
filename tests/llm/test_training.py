"""The training step does its work in few operations."""

import numpy as np

from poolscope.llm import recurrent


def test_weights_lie_in_one_array_and_follow_adam():
    """Each weight array was updated by itself before; the steps are those of Adam."""
    shape, rng = recurrent.Shape(12, 4, 3), np.random.default_rng(3)
    start = recurrent.initial(shape, rng.integers(1, 50, 15).astype(float))
    texts = [rng.integers(0, 15, n).astype(np.int32) for n in (5, 9, 1, 12)]
    trainer = recurrent.Trainer(start, shape, 0.01)
    tokens, owner = recurrent.lanes(texts)
    before, first = recurrent._inputs(tokens, owner, shape)
    _, n, g, _ = recurrent.gradients(start, shape, tokens[:16], before[:16], first[:16], np.zeros((tokens.shape[1], len(start["u"])), np.float32))
    trainer.fit(texts)
    assert all(np.shares_memory(v, trainer.flat) for v in trainer.p.values())
    if trainer.steps == 1:
        for k, v in start.items():
            d = np.clip(g[k], -1, 1)
            m, root = 0.1 * d, np.sqrt(0.001 * d * d) + 1e-8
            scale = 0.01 * (n / (n + 256)) * (1 - 0.999) ** 0.5 / (1 - 0.9)
            np.testing.assert_allclose(trainer.p[k], v - scale * m / root, atol=1e-5)
    else:
        assert trainer.steps > 1


def test_member_logits_equal_one_class_at_a_time():
    shape, rng = recurrent.Shape(10, 4, 3), np.random.default_rng(1)
    p = recurrent.initial(shape, rng.integers(1, 50, 13).astype(float))
    x, classes = rng.normal(size=(len(p["u"]), 7)).astype(np.float32), np.array([0, 0, 2, 2, 2, 4, 5])
    got = recurrent._member_logits(p, x, classes, list(recurrent._groups(classes, shape)))
    want = np.stack([p["wi"][c].T @ x[:, i] + p["bi"][c] for i, c in enumerate(classes[:5])], 1)
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-6)
    assert recurrent._member_logits(p, x, np.full(7, 4), []).shape[1] == 0
