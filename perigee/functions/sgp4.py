"""SGP4 over arrays: many satellites at once, each to its own time.

After Hoots & Roehrich, Spacetrack Report 3 (1980), with the corrections of Vallado et al., Revisiting Spacetrack Report 3
(AIAA 2006-6753); gravity constants of 1972. Orbits with periods of 225 minutes or more have the deep-space terms: secular
and periodic pulls of sun and moon, and the resonances of half-day and one-day orbits, integrated from the epoch in steps of
720 minutes.
"""

from __future__ import annotations

import numpy as np

# The 1972 world geodetic system.
MU, RE = 398600.8, 6378.135
J2, J3, J4 = 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RE**3 / MU)
TWO_PI = 2 * np.pi

# Fixed values of the deep-space theory: mean motions and eccentricities of sun and moon, strengths of their pulls, the
# ecliptic, the earth's turn in radians a minute.
ZNS, ZES, C_SUN = 1.19459e-5, 0.01675, 2.9864797e-6
ZNL, ZEL, C_MOON = 1.5835218e-4, 0.05490, 4.7968065e-7
SIN_I_SUN, COS_I_SUN, COS_G_SUN, SIN_G_SUN = 0.39785416, 0.91744867, 0.1945905, -0.98088458
TURN = 4.37526908801129966e-3
STEP = 720.0
# One-day resonance: strengths and phases of its three terms.
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
DAY_PHASES = (0.13130908, 2.8843198, 0.37448087)
# Half-day resonance: strengths by (degree, order), and phases.
ROOT22, ROOT32, ROOT44, ROOT52, ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
G22, G32, G44, G52, G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898
# Eccentricity functions of the half-day resonance: polynomials in e, lowest power first, by bounds of e.
ECCENTRIC = {
    "g211": [(0.65, (3.616, -13.2470, 16.2900)), (9, (-72.099, 331.819, -508.738, 266.724))],
    "g310": [(0.65, (-19.302, 117.3900, -228.4190, 156.5910)), (9, (-346.844, 1582.851, -2415.925, 1246.113))],
    "g322": [(0.65, (-18.9068, 109.7927, -214.6334, 146.5816)), (9, (-342.585, 1554.908, -2366.899, 1215.972))],
    "g410": [(0.65, (-41.122, 242.6940, -471.0940, 313.9530)), (9, (-1052.797, 4758.686, -7193.992, 3651.957))],
    "g422": [(0.65, (-146.407, 841.8800, -1629.014, 1083.4350)), (9, (-3581.690, 16178.110, -24462.770, 12422.520))],
    "g520": [(0.65, (-532.114, 3017.977, -5740.032, 3708.2760)), (0.715, (1464.74, -4664.75, 3763.64)), (9, (-5149.66, 29936.92, -54087.36, 31324.56))],
    "g533": [(0.7, (-919.22770, 4988.6100, -9064.7700, 5542.21)), (9, (-37995.780, 161616.52, -229838.20, 109377.94))],
    "g521": [(0.7, (-822.71072, 4568.6173, -8491.4146, 5337.524)), (9, (-51752.104, 218913.95, -309468.16, 146349.42))],
    "g532": [(0.7, (-853.66600, 4690.2500, -8624.7700, 5341.4)), (9, (-40023.880, 170470.89, -242699.48, 115605.82))],
}
#: What the error codes mean; 5 is no longer given by the theory's current form.
ERRORS = {
    1: "mean eccentricity is outside the range 0.0 to 1.0", 2: "nm is less than zero", 3: "perturbed eccentricity is outside the range 0.0 to 1.0",
    4: "semilatus rectum is less than zero", 6: "mrt is less than 1.0 which indicates the satellite has decayed",
}


def eccentric(name: str, e: np.ndarray) -> np.ndarray:
    """An eccentricity function; 0.65 and 0.715 belong to the lower range, 0.7 to the upper."""
    out, left = np.zeros(len(e)), np.ones(len(e), dtype=bool)
    for bound, powers in ECCENTRIC[name]:
        own = left & ((e < bound) if bound == 0.7 else (e <= bound))
        out[own] = sum(c * e[own] ** k for k, c in enumerate(powers))
        left &= ~own
    return out


class Pull:
    """How one body pulls at each orbit: secular rates, and the factors of its periodic terms."""

    def __init__(self, o: Orbits, cg: np.ndarray | float, sg: np.ndarray | float, ci: np.ndarray | float, si: np.ndarray | float, ch: np.ndarray, sh: np.ndarray, strength: float, rate: float, ecc: float):
        e2, c, s = o.e**2, o.c, o.s
        sw, cw = np.sin(o.argp), np.cos(o.argp)
        a1, a3 = cg * ch + sg * ci * sh, -sg * ch + cg * ci * sh
        a7, a8, a9, a10 = -cg * sh + sg * ci * ch, sg * si, sg * sh + cg * ci * ch, cg * si
        a2, a4, a5, a6 = c * a7 + s * a8, c * a9 + s * a10, -s * a7 + c * a8, -s * a9 + c * a10
        x1, x2, x3, x4 = a1 * cw + a2 * sw, a3 * cw + a4 * sw, -a1 * sw + a2 * cw, -a3 * sw + a4 * cw
        x5, x6, x7, x8 = a5 * sw, a6 * sw, a5 * cw, a6 * cw
        z31, z32, z33 = 12 * x1**2 - 3 * x3**2, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2**2 - 3 * x4**2
        beta2 = 1 - e2
        z1 = 2 * (3 * (a1**2 + a2**2) + z31 * e2) + beta2 * z31
        z2 = 2 * (6 * (a1 * a3 + a2 * a4) + z32 * e2) + beta2 * z32
        z3 = 2 * (3 * (a3**2 + a4**2) + z33 * e2) + beta2 * z33
        z11 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
        z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
        z13 = -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
        z21 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7)
        z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
        z23 = 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
        s3 = strength / o.n
        s2, s4 = -0.5 * s3 / np.sqrt(beta2), s3 * np.sqrt(beta2)
        s1 = -15 * o.e * s4
        s5, s6, s7 = x1 * x3 + x2 * x4, x2 * x3 + x1 * x4, x2 * x4 - x1 * x3
        # Secular rates; near the equator the node's is left out.
        self.e_dot, self.i_dot = s1 * rate * s5, s2 * rate * (z11 + z13)
        self.m_dot = -rate * s3 * (z1 + z3 - 14 - 6 * e2)
        flat = (o.inc < 5.2359877e-2) | (o.inc > np.pi - 5.2359877e-2)
        node = np.where(flat, 0.0, -rate * s2 * (z21 + z23))
        self.node_dot = np.where(s != 0, node / np.where(s != 0, s, 1), 0.0)
        self.argp_dot = s4 * rate * (z31 + z33 - 6) - c * self.node_dot
        # Periodic terms: factors of the two oscillations, and of the third that longitude and perigee have.
        self.e_p, self.i_p = (2 * s1 * s6, 2 * s1 * s7), (2 * s2 * z12, 2 * s2 * (z13 - z11))
        self.l_p = (-2 * s3 * z2, -2 * s3 * (z3 - z1), -2 * s3 * (-21 - 9 * e2) * ecc)
        self.gh_p, self.h_p = (2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * ecc), (-2 * s2 * z22, -2 * s2 * (z23 - z21))
        self.rate, self.ecc = rate, ecc

    def periodic(self, anomaly: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Changes of e, inclination, longitude, perigee and node."""
        zm = anomaly + self.rate * t
        zf = zm + 2 * self.ecc * np.sin(zm)
        sin = np.sin(zf)
        terms = (0.5 * sin * sin - 0.25, -0.5 * sin * np.cos(zf), sin)
        return [sum(f * x for f, x in zip(factors, terms, strict=False)) for factors in (self.e_p, self.i_p, self.l_p, self.gh_p, self.h_p)]


class Orbits:
    """Orbits ready to propagate. Angles in radians, mean motion in radians a minute, days since the first of 1950."""

    def __init__(self, n: np.ndarray, e: np.ndarray, inc: np.ndarray, node: np.ndarray, argp: np.ndarray, m: np.ndarray, bstar: np.ndarray, days: np.ndarray):
        self.e, self.inc, self.node, self.argp, self.m, self.bstar, self.days = e, inc, node, argp, m, bstar, days
        self.kozai, self.unread = n, np.isnan(n)
        with np.errstate(all="ignore"):
            self._prepare(n)
            self.deep = ~(TWO_PI / self.n < 225.0)
            self.simple |= self.deep
            self.far = np.nonzero(self.deep)[0]
            self.space = Space(self.some(self.far)) if len(self.far) else None
            self.error, _ = self._at(np.zeros(len(n)))

    def some(self, rows: np.ndarray) -> Orbits:
        """The orbits at these places, without their deep-space part."""
        out = Orbits.__new__(Orbits)
        out.__dict__ = {k: (v[rows] if isinstance(v, np.ndarray) and k != "far" else v) for k, v in self.__dict__.items()}
        return out

    def take(self, rows: np.ndarray) -> Orbits:
        """The orbits at these places, in their order; repeats are fine."""
        out = self.some(rows)
        out.far = np.nonzero(out.deep)[0]
        if len(out.far):
            at = np.searchsorted(self.far, rows[out.far])
            out.space = self.space.take(at)
        else:
            out.space = None
        return out

    def _prepare(self, n: np.ndarray) -> None:
        e, bstar = self.e, self.bstar
        e2, beta2 = e * e, 1 - e * e
        beta = np.sqrt(beta2)
        self.c, self.s = np.cos(self.inc), np.sin(self.inc)
        c2 = self.c**2
        # Mean motion without Kozai's mean.
        a = (XKE / n) ** (2 / 3)
        d = 0.75 * J2 * (3 * c2 - 1) / (beta * beta2)
        x = d / a**2
        x = d / (a * (1 - x * x - x * (1 / 3 + 134 * x * x / 81))) ** 2
        self.n = n = n / (1 + x)
        a = (XKE / n) ** (2 / 3)
        p2, rp = (a * beta2) ** 2, a * (1 - e)
        self.k41, k42 = 3 * c2 - 1, 1 - 5 * c2
        self.x1m, self.x7m = 1 - c2, 7 * c2 - 1
        self.simple = rp < 220 / RE + 1
        height = (rp - 1) * RE
        s4 = np.where(height < 98, 20.0, np.where(height < 156, height - 78, 78.0))
        q4 = ((120 - s4) / RE) ** 4
        s4 = s4 / RE + 1
        tsi = 1 / (a - s4)
        self.eta = eta = a * e * tsi
        eta2, ee = eta * eta, e * eta
        psi2 = np.abs(1 - eta2)
        f = q4 * tsi**4
        f1 = f / psi2**3.5
        cc2 = f1 * n * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * tsi / psi2 * self.k41 * (8 + 3 * eta2 * (8 + eta2)))
        self.c1 = c1 = bstar * cc2
        j = J3 / J2
        c3 = np.where(e > 1e-4, -2 * f * tsi * j * n * self.s / e, 0.0)
        self.c4 = 2 * n * f1 * a * beta2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * tsi / (a * psi2) * (-3 * self.k41 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * self.x1m * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * self.argp)))
        self.c5 = 2 * f1 * a * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
        c4 = c2 * c2
        t1 = 1.5 * J2 / p2 * n
        t2, t3 = 0.5 * t1 * J2 / p2, -0.46875 * J4 / p2**2 * n
        self.m_dot = n + 0.5 * t1 * beta * self.k41 + 0.0625 * t2 * beta * (13 - 78 * c2 + 137 * c4)
        self.argp_dot = -0.5 * t1 * k42 + 0.0625 * t2 * (7 - 114 * c2 + 395 * c4) + t3 * (3 - 36 * c2 + 49 * c4)
        xh = -t1 * self.c
        self.node_dot = xh + (0.5 * t2 * (4 - 19 * c2) + 2 * t3 * (3 - 7 * c2)) * self.c
        self.omg = bstar * c3 * np.cos(self.argp)
        self.xm = np.where(e > 1e-4, -2 / 3 * f * bstar / ee, 0.0)
        self.node_c, self.t2 = 3.5 * beta2 * xh * c1, 1.5 * c1
        low = np.where(np.abs(self.c + 1) > 1.5e-12, 1 + self.c, 1.5e-12)
        self.xl, self.ay = -0.25 * j * self.s * (3 + 5 * self.c) / low, -0.5 * j * self.s
        self.del_m0, self.sin_m0 = (1 + eta * np.cos(self.m)) ** 3, np.sin(self.m)
        c1c1 = c1 * c1
        self.d2 = 4 * a * tsi * c1c1
        t = self.d2 * tsi * c1 / 3
        self.d3 = (17 * a + s4) * t
        self.d4 = 0.5 * t * a * tsi * (221 * a + 31 * s4) * c1
        self.t3 = self.d2 + 2 * c1c1
        self.t4 = 0.25 * (3 * self.d3 + c1 * (12 * self.d2 + 10 * c1c1))
        self.t5 = 0.2 * (3 * self.d4 + 12 * c1 * self.d3 + 6 * self.d2**2 + 15 * c1c1 * (2 * self.d2 + c1c1))

    def at(self, minutes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(error codes, positions in km): 0 fine, 1 eccentricity, 2 mean motion, 3 eccentricity with the periodic terms,
        4 semi-latus rectum, 6 decayed."""
        with np.errstate(all="ignore"):
            return self._at(minutes)

    def _at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full, far = ~self.simple, self.far
        m = self.m + self.m_dot * t
        argp = self.argp + self.argp_dot * t
        node = self.node + self.node_dot * t + self.node_c * t * t
        ta, te, tl = 1 - self.c1 * t, self.bstar * self.c4 * t, self.t2 * t * t
        turn = self.omg * t + self.xm * ((1 + self.eta * np.cos(m)) ** 3 - self.del_m0)
        m2, argp2 = m + turn, argp - turn
        ta = np.where(full, ta - self.d2 * t**2 - self.d3 * t**3 - self.d4 * t**4, ta)
        te = np.where(full, te + self.bstar * self.c5 * (np.sin(m2) - self.sin_m0), te)
        tl = np.where(full, tl + self.t3 * t**3 + t**4 * (self.t4 + t * self.t5), tl)
        m, argp = np.where(full, m2, m), np.where(full, argp2, argp)
        n, e, inc = self.n.copy(), self.e.copy(), self.inc.copy()
        if len(far):
            n[far], e[far], inc[far], argp[far], node[far], m[far] = self.space.secular(t[far], e[far], inc[far], argp[far], node[far], m[far])
        error = np.where(~(n > 0), 2, 0)
        a = (XKE / n) ** (2 / 3) * ta**2
        e = e - te
        error = np.where((error == 0) & ((e >= 1) | (e < -0.001)), 1, error)
        e = np.maximum(e, 1e-6)
        m = m + self.n * tl
        x = m + argp + node
        node, argp, x = np.fmod(node, TWO_PI), np.fmod(argp, TWO_PI), np.fmod(x, TWO_PI)
        m = np.fmod(x - argp - node, TWO_PI)
        cos_i, sin_i, ay, xl = self.c.copy(), self.s.copy(), self.ay.copy(), self.xl.copy()
        k41, x1m, x7m = self.k41.copy(), self.x1m.copy(), self.x7m.copy()
        if len(far):
            e[far], inc[far], argp[far], node[far], m[far] = self.space.periodic(t[far], e[far], inc[far], argp[far], node[far], m[far])
            turned = self.deep & (inc < 0)
            inc, node, argp = np.where(turned, -inc, inc), np.where(turned, node + np.pi, node), np.where(turned, argp - np.pi, argp)
            error = np.where((error == 0) & self.deep & ((e < 0) | (e > 1)), 3, error)
            c, s = np.cos(inc[far]), np.sin(inc[far])
            cos_i[far], sin_i[far] = c, s
            ay[far] = -0.5 * J3 / J2 * s
            xl[far] = -0.25 * J3 / J2 * s * (3 + 5 * c) / np.where(np.abs(c + 1) > 1.5e-12, 1 + c, 1.5e-12)
            k41[far], x1m[far], x7m[far] = 3 * c * c - 1, 1 - c * c, 7 * c * c - 1
        axn = e * np.cos(argp)
        inv = 1 / (a * (1 - e * e))
        ayn = e * np.sin(argp) + inv * ay
        u = np.fmod(m + argp + node + inv * xl * axn - node, TWO_PI)
        # Kepler's equation.
        big, step = u.copy(), np.full(len(u), 9.0)
        for _ in range(10):
            sin, cos = np.sin(big), np.cos(big)
            new = (u - ayn * cos + axn * sin - big) / (1 - cos * axn - sin * ayn)
            step = np.where(np.abs(step) >= 1e-12, np.clip(new, -0.95, 0.95), 0.0)
            big = big + step
        sin, cos = np.sin(big), np.cos(big)
        ecos, esin, el2 = axn * cos + ayn * sin, axn * sin - ayn * cos, axn * axn + ayn * ayn
        pl = a * (1 - el2)
        error = np.where((error == 0) & (pl < 0), 4, error)
        r = a * (1 - ecos)
        bl = np.sqrt(1 - el2)
        tmp = esin / (1 + bl)
        su, cu = a / r * (sin - ayn - axn * tmp), a / r * (cos - axn + ayn * tmp)
        w = np.arctan2(su, cu)
        s2, c2 = 2 * cu * su, 1 - 2 * su * su
        t1 = 0.5 * J2 / pl
        t2 = t1 / pl
        r = r * (1 - 1.5 * t2 * bl * k41) + 0.5 * t1 * x1m * c2
        w = w - 0.25 * t2 * x7m * s2
        node = node + 1.5 * t2 * cos_i * s2
        inc = inc + 1.5 * t2 * cos_i * sin_i * c2
        error = np.where((error == 0) & (r < 1), 6, error)
        sw, cw, sn, cn, si, ci = np.sin(w), np.cos(w), np.sin(node), np.cos(node), np.sin(inc), np.cos(inc)
        place = np.stack([-sn * ci * sw + cn * cw, cn * ci * sw + sn * cw, si * sw], axis=1) * (r * RE)[:, None]
        return error, place


class Space:
    """The deep-space part of some orbits."""

    def __init__(self, o: Orbits):
        self.o = o
        day = o.days + 18261.5
        # The moon's orbit that day.
        rise = np.fmod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
        s, c = np.sin(rise), np.cos(rise)
        ci = 0.91375164 - 0.03568096 * c
        si = np.sqrt(1 - ci * ci)
        sh = 0.089683511 * s / si
        ch = np.sqrt(1 - sh * sh)
        gam = 5.8351514 + 0.0019443680 * day
        g = gam + np.arctan2(SIN_I_SUN * s / si, ch * c + COS_I_SUN * sh * s) - rise
        sn, cn = np.sin(o.node), np.cos(o.node)
        self.sun = Pull(o, COS_G_SUN, SIN_G_SUN, COS_I_SUN, SIN_I_SUN, cn, sn, C_SUN, ZNS, ZES)
        self.moon = Pull(o, np.cos(g), np.sin(g), ci, si, ch * cn + sh * sn, sn * ch - cn * sh, C_MOON, ZNL, ZEL)
        self.moon_at = np.fmod(4.7199672 + 0.22997150 * day - gam, TWO_PI)
        self.sun_at = np.fmod(6.2565837 + 0.017201977 * day, TWO_PI)
        pulls = (self.sun, self.moon)
        self.e_dot, self.i_dot, self.m_dot, self.argp_dot, self.node_dot = (sum(getattr(p, k) for p in pulls) for k in ("e_dot", "i_dot", "m_dot", "argp_dot", "node_dot"))
        ut = (o.days + 2433281.5 - 2451545.0) / 36525
        angle = -6.2e-6 * ut**3 + 0.093104 * ut**2 + (876600 * 3600 + 8640184.812866) * ut + 67310.54841
        self.green = np.mod(np.fmod(angle * np.pi / 180 / 240, TWO_PI), TWO_PI)
        self.day = (o.n > 0.0034906585) & (o.n < 0.0052359877)
        self.half = (o.n >= 8.26e-3) & (o.n <= 9.24e-3) & (o.e >= 0.5)
        self._resonances()

    def take(self, rows: np.ndarray) -> Space:
        def part(v):
            if isinstance(v, np.ndarray):
                return v[rows]
            if isinstance(v, tuple):
                return tuple(part(x) for x in v)
            if isinstance(v, Pull):
                out = Pull.__new__(Pull)
                out.__dict__ = {k: part(x) for k, x in v.__dict__.items()}
                return out
            return v.some(rows) if isinstance(v, Orbits) else v

        out = Space.__new__(Space)
        out.__dict__ = {k: part(v) for k, v in self.__dict__.items()}
        return out

    def _resonances(self) -> None:
        o = self.o
        e, e2, c, s = o.e, o.e**2, o.c, o.s
        c2, s2 = c * c, s * s
        inv = (o.n / XKE) ** (2 / 3)
        base = 3 * o.n**2 * inv**2
        # One day: three terms of the longitude.
        self.d1 = base * (0.9375 * s2 * (1 + 3 * c) - 0.75 * (1 + c)) * (1 + 2 * e2) * Q31 * inv
        self.d2 = 2 * base * 0.75 * (1 + c) ** 2 * (1 + e2 * (-2.5 + 0.8125 * e2)) * Q22
        self.d3 = 3 * base * 1.875 * (1 + c) ** 3 * (1 + e2 * (-6 + 6.60937 * e2)) * Q33 * inv
        # Half a day: ten terms (strength, multiple of the perigee, multiple of the longitude, phase).
        g = {k: eccentric(k, e) for k in ECCENTRIC}
        g["g201"] = -0.306 - (e - 0.64) * 0.440
        f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
        f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
        f441, f442 = 35 * s2 * f220, 39.3750 * s2 * s2
        f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
        f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
        f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
        f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
        b3, b4, b5 = base * inv, base * inv**2, base * inv**3
        self.terms = (
            (base * ROOT22 * f220 * g["g201"], 2, 1, G22), (base * ROOT22 * f221 * g["g211"], 0, 1, G22), (b3 * ROOT32 * f321 * g["g310"], 1, 1, G32), (b3 * ROOT32 * f322 * g["g322"], -1, 1, G32),
            (2 * b4 * ROOT44 * f441 * g["g410"], 2, 2, G44), (2 * b4 * ROOT44 * f442 * g["g422"], 0, 2, G44), (b5 * ROOT52 * f522 * g["g520"], 1, 1, G52), (b5 * ROOT52 * f523 * g["g532"], -1, 1, G52),
            (2 * b5 * ROOT54 * f542 * g["g521"], 1, 2, G54), (2 * b5 * ROOT54 * f543 * g["g533"], -1, 2, G54),
        )
        one = np.fmod(o.m + o.node + o.argp - self.green, TWO_PI)
        two = np.fmod(o.m + 2 * o.node - 2 * self.green, TWO_PI)
        self.longitude = np.where(self.half, two, one)
        fact1 = o.m_dot + o.argp_dot + o.node_dot - TURN + self.m_dot + self.argp_dot + self.node_dot - o.n
        fact2 = o.m_dot + self.m_dot + 2 * (o.node_dot + self.node_dot - TURN) - o.n
        self.fact = np.where(self.half, fact2, fact1)

    def _rates(self, at: np.ndarray, xli: np.ndarray, xni: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second rates of the mean motion, and the longitude's."""
        p1, p2, p3 = DAY_PHASES
        one = self.d1 * np.sin(xli - p1) + self.d2 * np.sin(2 * (xli - p2)) + self.d3 * np.sin(3 * (xli - p3))
        one_ = self.d1 * np.cos(xli - p1) + 2 * self.d2 * np.cos(2 * (xli - p2)) + 3 * self.d3 * np.cos(3 * (xli - p3))
        perigee = self.o.argp + self.o.argp_dot * at
        two, two_ = np.zeros(len(xli)), np.zeros(len(xli))
        for strength, j, k, phase in self.terms:
            two += strength * np.sin(j * perigee + k * xli - phase)
            two_ += k * strength * np.cos(j * perigee + k * xli - phase)
        turn = xni + self.fact
        return np.where(self.half, two, one), np.where(self.half, two_, one_) * turn, turn

    def secular(self, t, e, inc, argp, node, m):
        """Mean motion, eccentricity, inclination, perigee, node and anomaly with the secular terms and resonances."""
        e, inc, argp, node, m = e + self.e_dot * t, inc + self.i_dot * t, argp + self.argp_dot * t, node + self.node_dot * t, m + self.m_dot * t
        n = self.o.n.copy()
        bound = self.day | self.half
        if bound.any():
            at, xli, xni = np.zeros(len(t)), self.longitude.copy(), self.o.n.copy()
            step = np.where(t > 0, STEP, -STEP)
            while True:
                ndt, nddt, ldot = self._rates(at, xli, xni)
                going = bound & (np.abs(t - at) >= STEP)
                if not going.any():
                    break
                xli = np.where(going, xli + ldot * step + ndt * STEP * STEP / 2, xli)
                xni = np.where(going, xni + ndt * step + nddt * STEP * STEP / 2, xni)
                at = np.where(going, at + step, at)
            left = t - at
            longitude = xli + ldot * left + ndt * left * left * 0.5
            theta = np.fmod(self.green + t * TURN, TWO_PI)
            n = np.where(bound, xni + ndt * left + nddt * left * left * 0.5, n)
            m = np.where(self.half, longitude - 2 * node + 2 * theta, np.where(self.day, longitude - node - argp + theta, m))
        return n, e, inc, argp, node, m

    def periodic(self, t, e, inc, argp, node, m):
        """Eccentricity, inclination, perigee, node and anomaly with the periodic terms."""
        sun, moon = self.sun.periodic(self.sun_at, t), self.moon.periodic(self.moon_at, t)
        pe, pi, pl, pgh, ph = (a + b for a, b in zip(sun, moon, strict=True))
        inc, e = inc + pi, e + pe
        s, c = np.sin(inc), np.cos(inc)
        steep = inc >= 0.2
        h = ph / np.where(steep, s, 1.0)
        # Near the equator the node is ill defined: the changes go by its direction instead.
        sn, cn = np.sin(node), np.cos(node)
        alf, bet = s * sn + ph * cn + pi * c * sn, s * cn - ph * sn + pi * c * cn
        own = np.fmod(node, TWO_PI)
        total = m + argp + c * own + pl + pgh - pi * own * s
        new = np.arctan2(alf, bet)
        new = np.where(np.abs(own - new) > np.pi, np.where(new < own, new + TWO_PI, new - TWO_PI), new)
        m = m + pl
        argp = np.where(steep, argp + pgh - c * h, total - m - c * new)
        return e, inc, argp, np.where(steep, node + ph / np.where(steep, s, 1.0), new), m


def parse(line1: list[str], line2: list[str], days: np.ndarray) -> Orbits:
    """Orbits from records; days: their epochs since the beginning of 1950. A record that can't be read has nan throughout."""

    def power(f: str) -> float:
        return float(f[0].replace(" ", "+") + "0." + f[1:6].replace(" ", "0")) * 10.0 ** int(f[6:8])

    def one(a: str, b: str) -> list[float]:
        try:
            return [float(b[52:63]), float("0." + b[26:33]), float(b[8:16]), float(b[17:25]), float(b[34:42]), float(b[43:51]), power(a[53:61])]
        except ValueError:
            return [np.nan] * 7

    x = np.array([one(a, b) for a, b in zip(line1, line2, strict=True)], dtype=float).reshape(-1, 7).T
    deg = np.pi / 180
    return Orbits(x[0] * TWO_PI / 1440, x[1], x[2] * deg, x[3] * deg, x[4] * deg, x[5] * deg, x[6], np.asarray(days, dtype=float))
