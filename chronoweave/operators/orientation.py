"""Orientation from rate and acceleration samples, and smoothing of orientations, on numpy.

Quaternions are rows (w, x, y, z). Integrators start at a quarter turn about x; ``dt`` is each
row's own time step (``steps``) or one for all; rows without a rate keep the orientation. All are strictly sequential, so they run once for each series (``per_series``); simple integration
is a product of quaternions and is written as a tree of products.
"""

from __future__ import annotations

import math

import numpy as np

Q0 = np.array([math.cos(math.pi / 4), math.sin(math.pi / 4), 0.0, 0.0])
GRAVITY = 9.81


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over the last axis; b is applied first."""
    aw, ax, ay, az = np.moveaxis(a, -1, 0)
    bw, bx, by, bz = np.moveaxis(b, -1, 0)
    return np.stack([aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw], -1)


def conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1, -1, -1])


def unit(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=-1, keepdims=True)
    return q / np.where(n > 0, n, 1)


def turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v turned by q."""
    p = np.concatenate([np.zeros((*v.shape[:-1], 1)), v], -1)
    return mul(mul(q, p), conj(q))[..., 1:]


def exp(v: np.ndarray) -> np.ndarray:
    """The quaternion of rotation vectors."""
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.concatenate([np.cos(n / 2), v * np.where(n > 1e-12, np.sin(n / 2) / np.where(n > 1e-12, n, 1), 0.5)], -1)


def angle(q: np.ndarray) -> np.ndarray:
    return 2 * np.arccos(np.minimum(1.0, np.abs(q[..., 0])))


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    d = float(a @ b)
    if d < 0:
        b, d = -b, -d
    if d > 0.9995:
        return unit(a + t * (b - a))
    w = math.acos(min(d, 1.0))
    return unit((math.sin((1 - t) * w) * a + math.sin(t * w) * b) / math.sin(w))


def duration(t_us: np.ndarray) -> float:
    """Seconds that samples stand for: their span and one sample time more."""
    n = len(t_us)
    return float(t_us[-1] - t_us[0]) / 1e6 * (n + 1) / n if n else 0.0


def steps(t_us: np.ndarray, gyro: np.ndarray, lead: float = 1.0, repair: bool = True) -> np.ndarray:
    """Seconds from the row before that has a rate. The first row's step is ``lead`` mean sample
    times; with ``repair`` steps that aren't positive are one mean sample time."""
    n = len(t_us)
    if not n:
        return np.zeros(0)
    mean = duration(t_us) / n
    known = np.flatnonzero(~np.isnan(gyro).any(axis=1))
    out = np.zeros(n)
    if len(known):
        at = t_us[known] / 1e6
        out[known] = np.diff(at, prepend=t_us[0] / 1e6 - mean * lead)
        if repair:
            out[known] = np.where(out[known] > 0, out[known], mean)
    return out


def simple(gyro: np.ndarray, dt: float | np.ndarray) -> np.ndarray:
    """Rates alone: a prefix product of quaternions, in log2(n) vectorised rounds."""
    q = exp(np.nan_to_num(gyro) * np.reshape(np.broadcast_to(dt, len(gyro)), (-1, 1)))
    if len(q):
        q[0] = mul(Q0, q[0])
    step = 1
    while step < len(q):
        q = np.concatenate([q[:step], mul(q[:-step], q[step:])])
        step *= 2
    return unit(q)


def _each(gyro: np.ndarray, correct) -> np.ndarray:
    q, out = Q0.copy(), np.empty((len(gyro), 4))
    for i, w in enumerate(gyro):
        if not np.isnan(w).any():
            q = correct(q, w, i)
        out[i] = q
    return out


def _up(accel: np.ndarray, i: int) -> np.ndarray | None:
    a = accel[i]
    n = np.linalg.norm(a)
    return None if np.isnan(n) or n == 0 else a / n


def with_gravity(gyro: np.ndarray, accel: np.ndarray, dt: float | np.ndarray, strong: float = 10.0, weak: float = 0.6, settle_s: float = 15.0) -> np.ndarray:
    """Rates pulled towards gravity, strongly at first."""
    dt = np.broadcast_to(dt, len(gyro))
    since = np.cumsum(dt)

    def step(q, w, i):
        up = _up(accel, i)
        if up is not None:
            pull = np.cross(turn(q, up), [0.0, 0, 1])
            w = w + turn(conj(q), pull) * (strong if since[i] < settle_s else weak)
        return unit(mul(q, exp(w * dt[i])))

    return _each(gyro, step)


def _some_up(accel: np.ndarray, i: int) -> np.ndarray:
    """As ``_up``; a missing acceleration counts as one along x, a zero one as one along y."""
    up = _up(accel, i)
    return up if up is not None else np.array([1.0, 0, 0] if np.isnan(accel[i]).any() else [0.0, 1, 0])


def mahony(gyro: np.ndarray, accel: np.ndarray, dt: float | np.ndarray, kp: float = 0.5, ki: float = 0.0) -> np.ndarray:
    """Proportional and integral feedback of the tilt error."""
    dt = np.broadcast_to(dt, len(gyro))
    total = np.zeros(3)

    def step(q, w, i):
        nonlocal total
        error = np.cross(_some_up(accel, i), turn(conj(q), np.array([0.0, 0, 1])))
        total = total + error * dt[i]
        return unit(q + 0.5 * dt[i] * mul(q, np.concatenate([[0.0], w + kp * error + ki * total])))

    return _each(gyro, step)


def madgwick(gyro: np.ndarray, accel: np.ndarray, dt: float | np.ndarray, beta: float = 0.02) -> np.ndarray:
    """One step down the gradient of the tilt error a sample."""
    dt = np.broadcast_to(dt, len(gyro))

    def step(q, w, i):
        rate = 0.5 * mul(q, np.concatenate([[0.0], w]))
        a, b, c, d = q
        f = np.array([2 * (b * d - a * c), 2 * (a * b + c * d), 1 - 2 * (b * b + c * c)]) - _some_up(accel, i)
        j = np.array([[-2 * c, 2 * d, -2 * a, 2 * b], [2 * b, 2 * a, 2 * d, 2 * c], [0, -4 * b, -4 * c, 0]])
        g = j.T @ f
        n = np.linalg.norm(g)
        if n > 0:
            rate = rate - beta * g / n
        return unit(q + dt[i] * rate)

    return _each(gyro, step)


def complementary(gyro: np.ndarray, accel: np.ndarray, dt: float | np.ndarray, gain: float = 4e-4, bias_gain: float = 1e-3, tau: float = 0.1) -> np.ndarray:
    """Filtered gravity, bias learnt while steady, and a gain that depends on motion.

    Steady: rates below .01, acceleration within .1 of gravity and little change, for .2 s; the gain is then
    eight times as large. Otherwise it falls with the error in gravity's length and with the rate, and is larger while the start settles."""
    bias, gravity, held, last = np.zeros(3), GRAVITY, 0.0, None
    every = np.broadcast_to(dt, len(gyro))
    since = np.cumsum(every) - every
    smooth = None
    settle = min(0.05 * float(every.sum()), 2.0)

    def step(q, w, i):
        nonlocal bias, gravity, held, last, smooth
        a, dt = accel[i], float(every[i])
        weight = 1 - math.exp(-max(dt, 0.0) / tau)
        if np.isnan(a).any():
            return unit(mul(q, exp((w - bias) * dt)))
        smooth = a.copy() if smooth is None else smooth + weight * (a - smooth)
        size = float(np.linalg.norm(smooth))
        if abs(size - gravity) < 1.0:
            gravity += 5e-3 * (size - gravity)
        rate = w - bias
        calm = last is not None and np.linalg.norm(rate) < 0.01 and abs(size - gravity) < 0.1 and (np.abs(a - last[0]) < 0.05).all() and (np.abs(w - last[1]) < 0.01).all()
        held = held + dt if calm else 0.0
        last = (a, w)
        if held > 0.2:
            bias = bias + bias_gain * rate
            g = gain * 8
        else:
            g = gain * math.exp(-40 * abs(size - gravity) / gravity - float(np.linalg.norm(rate)))
            t = float(since[i])
            if settle > 0 and t < settle:
                g *= max(15 - 14 * t / settle, 8)
        q = unit(mul(q, exp((w - bias) * dt)))
        if size > 0:
            up = turn(q, smooth / size)
            pull = np.cross(up, [0.0, 0, 1])
            q = unit(mul(exp(pull * g), q))
        return q

    return _each(gyro, step)


def vqf(gyro: np.ndarray, accel: np.ndarray, dt: float, tau: float = 40.0) -> np.ndarray:
    """Strap-down integration with low-passed acceleration in the inertial frame and rest bias
    estimation, forward and backward merged (a compact form of the published filter; no magnetometer)."""
    from chronoweave.operators.filters import biquad

    gyro, n = np.nan_to_num(gyro), len(gyro)
    if not n:
        return np.zeros((0, 4))

    def biases(g: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bias and its variance when a pass has ended: learnt at rest."""
        b, p, still = np.zeros(3), np.full(3, 0.25), 0.0
        mean_g, mean_a, k = g[0].copy(), np.nan_to_num(a[0]), 1 - math.exp(-dt / 0.5)
        for w, f in zip(g, np.nan_to_num(a), strict=True):
            mean_g, mean_a = mean_g + k * (w - mean_g), mean_a + k * (f - mean_a)
            still = still + dt if np.linalg.norm(w - mean_g) < math.radians(2) and np.linalg.norm(f - mean_a) < 0.5 else 0.0
            p = np.minimum(p + 0.25 * dt / 100, 0.25)
            if still >= 1.5:
                gain = p / (p + 0.03**2 / max(dt, 1e-9))
                b = np.clip(b + gain * (mean_g - b), -math.radians(2), math.radians(2))
                p = (1 - gain) * p
        return b, p

    b1, p1 = biases(gyro, accel)
    b2, p2 = biases(-gyro[::-1], accel[::-1])
    bias = (b1 / p1 - b2 / p2) / (1 / p1 + 1 / p2)
    q = simple(gyro - bias, dt)
    earth = turn(q, np.nan_to_num(accel))
    fc = math.sqrt(2) / (2 * math.pi) / tau
    c = math.tan(math.pi * min(fc, 0.499 / dt) * dt)
    d = c * c + math.sqrt(2) * c + 1
    b, a = np.array([c * c, 2 * c * c, c * c]) / d, np.array([1.0, 2 * (c * c - 1) / d, (1 - math.sqrt(2) * c + c * c) / d])
    low = np.empty_like(earth)
    for k in range(3):
        x = earth[:, k]
        y = biquad(x, b, a, (x[0] * (1 - b[0]), x[0] * (b[2] - a[2])))[::-1]
        low[:, k] = biquad(y, b, a, (y[0] * (1 - b[0]), y[0] * (b[2] - a[2])))[::-1]
    size = np.linalg.norm(low, axis=1, keepdims=True)
    up = np.divide(low, size, out=np.tile([0.0, 0, 1], (n, 1)), where=size > 0)
    # the shortest turn that takes the filtered vertical to z
    w = np.sqrt(np.maximum((up[:, 2] + 1) / 2, 1e-12))
    tilt = unit(np.stack([w, 0.5 * up[:, 1] / w, -0.5 * up[:, 0] / w, np.zeros(n)], 1))
    return unit(mul(tilt, q))


def _follow(q: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Spherical exponential smoothing, forward and then backward."""
    out = q.copy()
    for order in (range(1, len(q)), range(len(q) - 2, -1, -1)):
        state = out[0 if order.step > 0 else len(q) - 1]
        for i in order:
            state = slerp(state, out[i], float(alpha[i]))
            out[i] = state
    return out


def _both_ways(x: np.ndarray, alpha: float) -> np.ndarray:
    x = x.copy()
    for i in range(1, len(x)):
        x[i] = x[i - 1] * (1 - alpha) + x[i] * alpha
    for i in range(len(x) - 2, -1, -1):
        x[i] = x[i + 1] * (1 - alpha) + x[i] * alpha
    return x


def smooth_plain(q: np.ndarray, rate: float, tau: float = 0.25, limits: np.ndarray | None = None) -> np.ndarray:
    """One time constant; an optional limit for each row divides the weight."""
    if len(q) < 2:
        return q
    alpha = np.full(len(q), 1 - math.exp(-1 / (rate * tau)))
    return _follow(q, alpha if limits is None else alpha / limits)


def smooth_default(q: np.ndarray, rate: float, smoothness: float = 0.5, slow_s: float = 1.0, fast_s: float = 0.1) -> np.ndarray:
    """Smoothing that lets go when motion is fast, then again by how far it has strayed."""
    if len(q) < 2:
        return q
    weight = lambda tau: 1 - math.exp(-1 / (rate * tau))
    slow, fast = weight(slow_s), weight(fast_s)
    speed = np.concatenate([[0.0], angle(mul(conj(q[:-1]), q[1:]))]) * rate * 180 / math.pi
    ratio = _both_ways(speed, weight(0.1)) / (500 * smoothness * 0.5)
    first = _follow(q, np.minimum(1, slow * (1 - ratio) + fast * ratio))
    away = angle(mul(conj(q), first))
    if away.max() > 0:
        away = away / away.max()
    away = _both_ways(np.where(away < 0.5, 0, away), weight(0.1))
    if away.max() > 0:
        away = away / away.max()
    ratio = ratio * (away + 1) / 2
    return _follow(first, np.minimum(1, slow * (1 - ratio) + fast * ratio))


def adaptive_ema(x: np.ndarray, rate: float, slow_s: float, fast_s: float, top_speed: float) -> np.ndarray:
    """A positive series with gaps: heavier smoothing where its relative change is slow; both ways.

    Gaps hold the state; rows before the first known value stay unknown."""
    n = len(x)
    known = ~np.isnan(x)
    if n < 2 or rate <= 0 or not known.any():
        return x
    slow, fast = (1 - math.exp(-1 / (rate * max(s, 1e-3))) for s in (slow_s, fast_s))
    speed = np.zeros(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        change = np.abs((x[1:] - x[:-1]) * rate / x[:-1])
    good = known[1:] & known[:-1] & (np.nan_to_num(x[:-1]) > 0)
    speed[1:][good] = change[good]
    speed[0] = speed[1]
    speed = _both_ways(speed, fast)
    ratio = np.minimum(speed / top_speed, 1.0) if top_speed > 1e-6 else np.ones(n)
    alpha = slow * (1 - ratio) + fast * ratio
    first = int(np.flatnonzero(known)[0])
    out = np.full(n, np.nan)
    state = x[first]
    for i in range(first, n):
        if known[i]:
            state = state * (1 - alpha[i]) + x[i] * alpha[i]
        out[i] = state
    for i in range(n - 1, first - 1, -1):
        state = state * (1 - alpha[i]) + out[i] * alpha[i]
        out[i] = state
    return out


def rate_control(t_us: np.ndarray, speed: np.ndarray, fps: float) -> np.ndarray:
    """Copies of each row in an output of ``fps`` at a speed; 0 drops it."""
    interval = round(1e6 / fps)
    before = ramp = done = 0.0
    out = np.zeros(len(t_us), np.int64)
    for i, (t, s) in enumerate(zip(t_us.tolist(), speed.tolist(), strict=True)):
        step = (t - before) / (s if s > 0 else 1.0)
        ramp, before = ramp + step, t
        if ramp >= done + interval / 2:
            out[i] = max(1, round(step / interval)) if step / interval >= 1.5 else 1
            done += interval * out[i]
    return out
