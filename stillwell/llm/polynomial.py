"""Exact characteristic polynomials of whole-number matrices, their real roots, and null vectors at a root."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Primes stay below this, so that a product of two residues fits 62 bits.
PRIME_BELOW = 1 << 31


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.2 * 10**9."""
    if n < 9 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Descending primes below PRIME_BELOW whose product is larger than ``bound``."""
    found, product, n = [], 1, PRIME_BELOW
    while product <= bound:
        n -= 1
        if is_prime(n):
            found.append(n)
            product *= n
    return found


def coefficient_bound(m: list[list[int]]) -> int:
    """No coefficient of a positive semidefinite matrix's characteristic polynomial is larger (Maclaurin's inequality)."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    return max((math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)), default=1)


def inverse_mod(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    return np.array([pow(int(v), -1, int(p)) for v, p in zip(values, primes)], dtype=np.int64)


def hessenberg_mod(m: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Similar upper Hessenberg matrices of ``m`` (one per prime: shape primes, d, d), each modulo its own prime."""
    h, p = m.copy(), primes[:, None]
    d = h.shape[1]
    for k in range(d - 2):
        below = h[:, k + 1:, k] != 0
        swap = np.flatnonzero(~below[:, 0] & below.any(axis=1))
        for one in swap:
            other = k + 1 + int(below[one].argmax())
            h[one, [k + 1, other]] = h[one, [other, k + 1]]
            h[one][:, [k + 1, other]] = h[one][:, [other, k + 1]]
        live = np.flatnonzero(below.any(axis=1))
        if not len(live):
            continue
        part, q = h[live], p[live]
        times = part[:, k + 2:, k] * inverse_mod(part[:, k + 1, k], primes[live])[:, None] % q
        part[:, k + 2:] = (part[:, k + 2:] - times[:, :, None] * part[:, k + 1, None, :] % q[:, :, None]) % q[:, :, None]
        # products are reduced one by one, and at most d of them are added
        part[:, :, k + 1] = (part[:, :, k + 1] + (part[:, :, k + 2:] * times[:, None, :] % q[:, :, None]).sum(axis=2)) % q
        h[live] = part
    return h


def polynomials_mod(m: list[list[int]], primes: Sequence[int]) -> np.ndarray:
    """Coefficients of det(xI - m) modulo each prime, constant term first: shape (primes, d + 1)."""
    d, p = len(m), np.array(primes, dtype=np.int64)
    flat = [[v % q for row in m for v in row] for q in map(int, primes)]
    h = hessenberg_mod(np.array(flat, dtype=np.int64).reshape(len(p), d, d), p)
    q = p[:, None]
    polys = [np.ones((len(p), 1), dtype=np.int64)]
    for k in range(d):
        new = np.zeros((len(p), k + 2), dtype=np.int64)
        new[:, 1:] = polys[k]
        new[:, :-1] = (new[:, :-1] - h[:, k, k, None] * polys[k] % q) % q
        chain = np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new[:, :i + 1] = (new[:, :i + 1] - (h[:, i, k] * chain % p)[:, None] * polys[i] % q) % q
        polys.append(new)
    return polys[d]


def from_residues(residues: Sequence[int], primes: Sequence[int]) -> int:
    """The whole number of least size with these residues (Chinese remaindering)."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def shifted(coefficients: list[int], numerator: int, bits: int) -> list[int]:
    """Coefficients of 2**(bits * d) times p(x + numerator / 2**bits), up to positive factors of each."""
    d = len(coefficients) - 1
    out = [c << bits * (d - k) for k, c in enumerate(coefficients)]      # roots times 2**bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            out[k] += numerator * out[k + 1]
    return out


def roots_above(coefficients: list[int], numerator: int, bits: int) -> int:
    """How many roots are larger than numerator / 2**bits; sign changes tell, since all roots are real (Descartes)."""
    signs = [c > 0 for c in shifted(coefficients, numerator, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(coefficients: list[int], numerator: int, bits: int) -> int:
    """Sign of p(numerator / 2**bits)."""
    value, power = 0, 0
    for c in reversed(coefficients):
        value = value * numerator + (c << power)
        power += bits
    return (value > 0) - (value < 0)


def real_roots(coefficients: list[int], count: int, digits: int = 80) -> list[tuple[int, int]]:
    """The ``count`` largest roots, each as (numerator, bits), of a monic polynomial with real roots only, none below 0.

    Roots are told apart by exact counts and then halved in by the polynomial's sign; each is known to a share of
    2**-digits of itself, or of the largest where it is smaller still. Roots of several fold, or that lie closer than
    that, come as often as they count. Roots of 0 are exact.
    """
    zeros = next(k for k, c in enumerate(coefficients) if c)
    core, d = coefficients[zeros:], len(coefficients) - 1
    out: list[tuple[int, int]] = []
    if len(core) > 1:
        top = max(-core[-2], 1).bit_length()                       # all roots together are -c[d - 1]
        stack = [(0, 1, -top, len(core) - 1)]                      # (low, low + 1] / 2**bits holds that many roots
        while stack and len(out) < count:
            low, high, bits, inside = stack.pop()
            small = bits > digits + 64 or (low > 0 and low.bit_length() > digits)
            if inside == 1 or small:
                out += [_halved(core, low, bits, digits)] * inside if not small else [(2 * low + 1, bits + 1)] * inside
                continue
            bits += 1
            middle = 2 * low + 1
            above = roots_above(core, middle << max(-bits, 0), max(bits, 0)) - roots_above(core, (2 * low + 2) << max(-bits, 0), max(bits, 0))
            for part, number in ((2 * low, inside - above), (middle, above)):
                if number:
                    stack.append((part, part + 1, bits, number))   # the upper half is looked at first
    out += [(0, 0)] * zeros
    return out[:min(count, d)]


def _halved(core: list[int], low: int, bits: int, digits: int) -> tuple[int, int]:
    """Halve (low, low + 1] / 2**bits, which holds one simple root, until it is known to ``digits`` binary digits."""
    end = sign_at(core, (low + 1) << max(-bits, 0), max(bits, 0))
    if end == 0:
        return low + 1, bits
    while low.bit_length() <= digits:
        low, bits = 2 * low, bits + 1
        at = sign_at(core, (low + 1) << max(-bits, 0), max(bits, 0))
        if at == 0:
            return low + 1, bits
        low += at != end
    return 2 * low + 1, bits + 1


def null_vectors(m: np.ndarray, roots: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit vectors u with m u = root u, one column per root (falling): inverse iteration, residuals in long double.

    ``m`` and ``roots`` are long doubles of like size. Vectors of roots that lie close together are made
    perpendicular in turn, so roots of several fold get a basis of their space.
    """
    d = len(m)
    scale = max(float(np.abs(m).max(initial=0)), 1e-300)
    rng = np.random.default_rng(4)
    out = np.zeros((d, len(roots)), dtype=np.longdouble)
    for k, root in enumerate(roots):
        near = [j for j in range(k) if abs(float(roots[j] - root)) <= 1e-3 * scale]
        # a little off the root, else the system has no solution where the root is met exactly
        system = (m - np.eye(d, dtype=np.longdouble) * (root + np.longdouble(scale * 1e-15))).astype(float)
        u = rng.standard_normal(d).astype(np.longdouble)
        for step in range(rounds):
            u = u - out[:, near] @ (out[:, near].T @ u)
            u /= np.sqrt((u * u).sum())
            if step < 2:
                u = np.linalg.solve(system, u.astype(float)).astype(np.longdouble)
            else:
                # Newton's step from the exact residual gives the digits that doubles left out
                rest = m @ u - root * u
                fix = np.linalg.solve(system, rest.astype(float)).astype(np.longdouble)
                u = u - (fix - u * (u @ fix))
        u = u - out[:, near] @ (out[:, near].T @ u)
        out[:, k] = u / np.sqrt((u * u).sum())
    return out
