"""Plain Python versions that the operators are held against."""

import hashlib
import re

SECRETS = [
    ("assign", re.compile(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def n_digits(s):
    return sum(c in "0123456789" for c in s)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: luhn(m[0])),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= n_digits(m[0]) <= 15),
]


def base(text, kinds):
    """Counts by kind and base_sha256."""
    spans = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return [sum(x[1] == i for x in spans) for i in range(len(kinds))], hashlib.sha256(listed.encode()).hexdigest(), listed
