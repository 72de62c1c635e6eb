"""Secret scan: a character convolutional network over every candidate and its surroundings.

Candidates are found in numpy: runs of 16 or more token characters that hold both a letter and a
digit or the opening of an issued token, values of 8 or more characters assigned to a name that
speaks of a credential, passwords in URLs, and private key headers. Each becomes a window of ``LEFT`` bytes before it, the candidate
(``MIDDLE`` bytes; of a longer one the head and the tail, while its statistics cover all of it) and
``RIGHT`` bytes after it. Two convolutions with pooling, over learnt character vectors, feed a
logistic output together with those statistics.

The network is trained in numpy on labelled findings that ``findings`` makes from a seed: credentials
of many issuers and forms, and the look-alikes that scans trip over (checksums, commits, identifiers,
addresses, numbers, placeholders), each as the candidate that covers it in its text. A held-out part
fits Platt's scaling and then the threshold: the highest one that keeps the recall asked for, of all
secrets, those that are no candidate included. Training is the same for any corpus; a corpus's own
labelled findings can be passed instead.

Scale: one map over the texts, no shuffle; the network is a few kilobytes in the tasks' closure.

Defined cases: a null or empty text has no findings and stays as it is; a null id passes through;
repeated rows give repeated findings; candidates that overlap count as one; a score that ties with the
threshold is a finding; a very long text is a slice of its own; an empty table gives none. Columns beside the id and the text
are never read, and ``redact`` returns them as they are. A candidate may be as long as a text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._words import slices, text_bytes

LEFT, MIDDLE, RIGHT = 40, 64, 16
WIDTH = LEFT + MIDDLE + RIGHT
#: Labelled findings that the built-in network is trained on, and the recall its threshold keeps.
FINDINGS, RECALL, SEED = 6000, 0.98, 11

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-.~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_NAME = re.compile(rb"(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|secret|private|encryption|decryption|signing|signature|auth|master|session|service|account|client|storage|ssh|rsa|hmac|aes|deploy|webhook)[_-]?key|credential)s?[\"']?[ \t]{0,4}\Z")
#: Openings of issued tokens, which may happen to hold no digit.
_ISSUED = re.compile(rb"AKIA|gh[oprsu]_|sk_live_|xox[abprs]-|AIza|SG\.|glpat-|eyJ")
_VALUE = re.compile(rb"(?:=>|[:=]=?)[ \t]*[\"']?([^\s\"',;<>]{8,})")
_IN_URL = re.compile(rb"://[^\s:/@]+:([^\s:/@]{6,})@")
_HEADER = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
#: Bytes as the network sees them: lower case, upper case as one group each of hex and other, digits,
#: marks one by one, white space, anything beyond ASCII.
_SYMBOL = np.full(256, 63, np.uint8)
for _k, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _SYMBOL[_c] = _k + 1
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _SYMBOL[_c] = 37 if _c in b"ABCDEF" else 38
for _k, _c in enumerate(b"\"'=:;,._-+/@#$%&*!?()[]{}"):
    _SYMBOL[_c] = 39 + min(_k, 22)
_SYMBOL[[*b" \t\n\r"]] = 62
_DIMS, _F1, _F2, _STATS = 8, 24, 24, 8


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte (exclusive) of every candidate, in order, without overlaps."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    token = np.concatenate([[False], _TOKEN[raw], [False]])
    begin = np.flatnonzero(token[1:-1] & (~token[:-2] | edge[:-1]))
    end = np.flatnonzero(token[1:-1] & (~token[2:] | edge[1:])) + 1
    long = end - begin >= 16
    begin, end = begin[long], end[long]
    data = raw.tobytes()
    if len(begin):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        alphas = np.concatenate([[0], np.cumsum(_ALPHA[raw])])
        mixed = (digits[end] > digits[begin]) & (alphas[end] > alphas[begin])
        mixed[~mixed] = [_ISSUED.search(data, a, b) is not None for a, b in zip(begin[~mixed].tolist(), end[~mixed].tolist())]
        begin, end = begin[mixed], end[mixed]
    found = list(zip(begin.tolist(), end.tolist()))
    # All rows' bytes are joined, so each pattern sees only those of its own row.
    marks = np.array([m.start() for m in re.finditer(rb"-----BEGIN ", data)], np.int64)
    for at, last in zip(marks.tolist(), off[np.searchsorted(off, marks, "right")].tolist()):
        if m := _HEADER.match(data, at, last):
            found.append(m.span())
    marks = np.flatnonzero((raw == 61) | (raw == 58))  # = and :
    row = np.searchsorted(off, marks, "right")
    for at, start, last in zip(marks.tolist(), off[row - 1].tolist(), off[row].tolist()):
        if (m := _IN_URL.match(data, at, last)) or (_NAME.search(data[max(start, at - 24) : at]) and (m := _VALUE.match(data, at, last))):
            found.append(m.span(1))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    begin, end = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
    return np.searchsorted(off, begin, "right") - 1, begin, end


def covering(raw: np.ndarray, off: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans, one in each row: first and last byte of the candidate that covers it, and whether there
    is one; else the span stays as it is."""
    _, first, last = candidates(raw, off)
    if not len(first):
        return begin, end, np.zeros(len(begin), bool)
    at = np.maximum(np.searchsorted(first, begin, "right") - 1, 0)
    seen = (first[at] <= begin) & (last[at] >= end)
    return np.where(seen, first[at], begin), np.where(seen, last[at], end), seen


def windows(raw: np.ndarray, off: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols around the candidates and statistics of them."""
    k = np.arange(WIDTH)
    size = (end - begin)[:, None]
    middle, tail = k - LEFT, MIDDLE // 4
    at = np.where(
        k < LEFT,
        begin[:, None] + middle,
        np.where(k < LEFT + MIDDLE, np.where((size > MIDDLE) & (middle >= MIDDLE - tail), end[:, None] + middle - MIDDLE, begin[:, None] + middle), end[:, None] + k - LEFT - MIDDLE),
    )
    inside = (at >= off[row][:, None]) & (at < off[row + 1][:, None]) & ~((k >= LEFT) & (k < LEFT + MIDDLE) & (middle >= size))
    symbols = np.where(inside, _SYMBOL[raw[np.clip(at, 0, max(0, len(raw) - 1))]], 0).astype(np.uint8)
    stats = np.zeros((len(begin), _STATS), np.float32)
    for r, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        part = raw[a:b]
        share = np.bincount(part, minlength=256) / len(part)
        some = share[share > 0]
        hexed = share[48:58].sum() + share[97:103].sum() + share[65:71].sum()
        change = np.mean(_DIGIT[part[1:]] != _DIGIT[part[:-1]]) if len(part) > 1 else 0
        stats[r] = (np.log2(len(part)) / 6, -(some * np.log2(some)).sum() / 6, share[48:58].sum(), share[65:91].sum(), share[97:123].sum(), hexed, change, share[45] + share[46])
    return symbols, stats


@dataclass
class Network:
    """Weights, Platt's scaling and the threshold on the calibrated probability."""

    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _forward(self, symbols: np.ndarray, stats: np.ndarray) -> tuple:
        w = self.weights
        mark = np.zeros((WIDTH, 1), np.float32)
        mark[LEFT : LEFT + MIDDLE] = 1
        x = np.concatenate([w["letters"][symbols], np.broadcast_to(mark, (len(symbols), WIDTH, 1))], 2)
        c1 = np.lib.stride_tricks.sliding_window_view(x, 5, 1).reshape(len(x), WIDTH - 4, -1)
        h1 = np.maximum(c1 @ w["first"] + w["first_b"], 0)
        p1 = h1[:, : (WIDTH - 4) // 2 * 2].reshape(len(x), -1, 2, _F1)
        m1 = p1.max(2)
        c2 = np.lib.stride_tricks.sliding_window_view(m1, 5, 1).reshape(len(x), m1.shape[1] - 4, -1)
        h2 = np.maximum(c2 @ w["second"] + w["second_b"], 0)
        cut = LEFT // 2 - 2
        top = np.concatenate([h2[:, :cut].max(1), h2[:, cut:].max(1), stats], 1)
        return x, c1, h1, p1, m1, c2, h2, top, top @ w["out"] + w["out_b"]

    def logits(self, symbols: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self._forward(symbols[k : k + 256], stats[k : k + 256])[-1][:, 0] for k in range(0, len(symbols), 256))])

    def scores(self, symbols: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(symbols, stats).astype(np.float64) + b, -50, 50)))

    def _gradients(self, symbols: np.ndarray, stats: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x, c1, h1, p1, m1, c2, h2, top, z = self._forward(symbols, stats)
        n, cut = len(x), LEFT // 2 - 2
        dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - truth[:, None]).astype(np.float32) / n
        g = {"out": top.T @ dz, "out_b": dz.sum(0)}
        dtop = dz @ w["out"].T
        dh2 = np.zeros_like(h2)
        rows, cols = np.arange(n)[:, None], np.arange(_F2)[None, :]
        dh2[rows, h2[:, :cut].argmax(1), cols] = dtop[:, :_F2]
        dh2[rows, h2[:, cut:].argmax(1) + cut, cols] += dtop[:, _F2 : 2 * _F2]
        dh2 *= h2 > 0
        g["second"], g["second_b"] = np.tensordot(c2, dh2, ([0, 1], [0, 1])), dh2.sum((0, 1))
        dm1 = np.zeros_like(m1)
        dc2 = (dh2 @ w["second"].T).reshape(n, -1, _F1, 5)
        for k in range(5):
            dm1[:, k : k + dc2.shape[1]] += dc2[..., k]
        dp1 = (p1 == m1[:, :, None]) * dm1[:, :, None]
        dh1 = np.zeros_like(h1)
        dh1[:, : dp1.shape[1] * 2] = dp1.reshape(n, -1, _F1)
        dh1 *= h1 > 0
        g["first"], g["first_b"] = np.tensordot(c1, dh1, ([0, 1], [0, 1])), dh1.sum((0, 1))
        dc1 = (dh1 @ w["first"].T).reshape(n, -1, _DIMS + 1, 5)
        dx = np.zeros_like(x)
        for k in range(5):
            dx[:, k : k + dc1.shape[1]] += dc1[..., k]
        g["letters"] = np.zeros_like(w["letters"])
        np.add.at(g["letters"], symbols.reshape(-1), dx[..., :_DIMS].reshape(-1, _DIMS))
        return g


def train(found: list[tuple[str, int, int, bool]], recall: float = RECALL, epochs: int = 6, seed: int = SEED) -> Network:
    """Fits the network to labelled findings ``(text, first, last, secret)`` (places in bytes): three
    quarters for the weights, the rest for the scaling and the threshold."""
    rng = np.random.default_rng(seed)
    data = [f[0].encode() for f in found]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    row = np.arange(len(found))
    begin, end, seen = covering(raw, off, off[:-1] + [f[1] for f in found], off[:-1] + [f[2] for f in found])
    symbols, stats = windows(raw, off, row, begin, end)
    truth = np.array([f[3] for f in found], np.float32)
    order = rng.permutation(len(found))
    fit, rest = order[: len(order) * 3 // 4], order[len(order) * 3 // 4 :]
    normal = lambda *shape, fan: rng.normal(0, (2 / fan) ** 0.5, shape).astype(np.float32)
    net = Network(
        {
            "letters": normal(64, _DIMS, fan=16), "first": normal((_DIMS + 1) * 5, _F1, fan=(_DIMS + 1) * 5), "first_b": np.zeros(_F1, np.float32),
            "second": normal(_F1 * 5, _F2, fan=_F1 * 5), "second_b": np.zeros(_F2, np.float32), "out": normal(2 * _F2 + _STATS, 1, fan=100), "out_b": np.zeros(1, np.float32),
        }
    )
    mean, square = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            step += 1
            for k, g in net._gradients(symbols[part], stats[part], truth[part]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - np.float32(3e-3) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + np.float32(1e-7))
    logit, held = net.logits(symbols[rest], stats[rest]).astype(np.float64), truth[rest]
    a, b = 1.0, 0.0
    soft = np.where(held > 0, (held.sum() + 1) / (held.sum() + 2), 1 / (len(held) - held.sum() + 2))
    for _ in range(200):  # Platt's scaling, by gradient steps on the smoothed labels
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -50, 50)))
        a, b = a - 0.5 * np.mean((p - soft) * logit) / max(1.0, np.mean(logit**2)), b - 0.5 * np.mean(p - soft)
    net.scale = float(a), float(b)
    good = np.sort(net.scores(symbols[rest], stats[rest])[(held > 0) & seen[rest]])
    lost = int(held.sum()) - len(good)
    net.threshold = float(min(0.5, good[max(0, int((1 - recall) * held.sum()) - lost)])) if len(good) else 0.5
    return net


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, bool]]:
    """Labelled findings: text, first and last byte of the candidate, and whether it is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, a, b=None: "".join(letters[k] for k in rng.integers(0, len(letters), a if b is None else int(rng.integers(a, b + 1))))
    hexed, base = digit + "abcdef", lower + upper + digit
    parts = "the of and to in is that for it was on are as with his they at be this from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part er on en re ti ou der die das und le la les que el en de".split()
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 4))))
    prose = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b + 1))))
    assign = lambda: pick([" = ", "=", ": ", ' = "', '="', '": "', " => '", ":"])
    name = lambda: pick(["", "", "MY_", "app_", "prod_", "client_", "db_"]) + pick(["token", "secret", "password", "api_key", "apikey", "API_KEY", "access_token", "auth_token", "SECRET_KEY", "private_key", "passwd", "pwd", "credential"])
    value = lambda: pick([lambda: some(hexed, pick([32, 40, 40, 64])), lambda: some(base, 20, 48), lambda: some(base + "+/", 40) + pick(["", "=", "=="]), lambda: some(base + "-_", 24, 64), lambda: some(base + "!#%^*", 10, 24)])()
    close = lambda lead: {'"': '"', "'": "'"}.get(lead[-1], "")
    issued = [
        lambda: "AKIA" + some(upper + digit, 16), lambda: "ghp_" + some(base, 36), lambda: "sk_live_" + some(base, 24), lambda: "xoxb-" + some(digit, 11) + "-" + some(digit, 12) + "-" + some(base, 24),
        lambda: "AIza" + some(base + "-_", 35), lambda: "SG." + some(base, 22) + "." + some(base, 43), lambda: "glpat-" + some(base, 20), lambda: "eyJ" + some(base, 33) + ".eyJ" + some(base, 60) + "." + some(base + "-_", 43),
    ]
    plain = [
        lambda: ("commit ", some(hexed, 40), ""), lambda: (pick(["sha256:", "SHA-256 ", "checksum "]), some(hexed, 64), ""), lambda: (pick(["md5 ", "MD5: ", "etag "]), some(hexed, 32), ""),
        lambda: (pick(["id ", "uuid=", "request ", ""]), "-".join(some(hexed, k) for k in (8, 4, 4, 4, 12)), ""), lambda: (" ", word() + "." + some(digit, 2), "@mail.example.com"),
        lambda: ("@", "mail" + some(digit, 1) + "." + pick(["example.com", "example.net", "example.org"]), ""), lambda: (" ", word() + "-" + word() + "-" + some(digit, 2, 4) + "." + pick(["html", "pdf", "jpg", "tar.gz"]), ""),
        lambda: ("https:", "//www." + word() + ".com/" + word() + "/" + some(digit, 2, 6), ""), lambda: ("version ", "v" + some(digit, 1) + "." + some(digit, 1, 2) + "." + some(digit, 1, 2) + "-" + pick(["alpha", "beta", "release"]) + "." + some(digit, 1), ""),
        lambda: ("data:image/png;base64,", some(base + "+/", 60, 200), ""), lambda: (name() + assign(), pick(["YOUR_API_KEY_HERE_123", "xxxxxxxxxxxxxxxx0000", "changeme1234567890", "<insert-token-here-1>", "0000000000000000abcd"]), ""),
        lambda: (" ", word() + word() + word() + word() + some(digit, 1, 4), ""), lambda: (pick(["ISBN ", "IBAN ", "order "]), pick(["DE", "FR", "NO"]) + some(digit, 18), ""), lambda: ("at ", "20" + some(digit, 2) + "-0" + some(digit, 1) + "-1" + some(digit, 1) + "T1" + some(digit, 1) + "-00-00Z", ""),
        lambda: ("line ", "=" * 12 + word() + some(digit, 1) + "=" * 8, ""), lambda: ("blob ", some(hexed, 40), ""), lambda: ("index ", some(hexed, 20) + ".." + some(hexed, 20), ""), lambda: (name() + assign(), word() + pick(["", "_"]) + word() + "Value" + pick(["", "1"]), ""),
    ]
    out = []
    for k in range(n):
        secret = k % 2 == 0
        if secret:
            kind = int(rng.integers(10))
            if kind < 5:
                lead = name() + assign()
                mid = value()
                tail = close(lead)
            elif kind < 8:
                lead, mid, tail = pick(["", '"', "key ", "Authorization: Bearer ", name() + "="]), pick(issued)(), ""
            elif kind == 8:
                lead, mid, tail = pick(["postgres", "https", "mysql", "amqp"]) + "://" + word() + ":", some(base, 8, 24), "@db.example.com/x"
            else:
                kind = pick(["RSA ", "EC ", "", "OPENSSH "]) + "PRIVATE KEY-----"
                body = "".join("\n" + some(base + "+/", 64) for _ in range(int(rng.integers(1, 6))))
                lead, mid, tail = ("", f"-----BEGIN {kind}{body}\n-----END {kind}", "") if rng.integers(2) else ("", f"-----BEGIN {kind}", body)
        else:
            lead, mid, tail = pick(plain)()
        before = prose(0, 12) + pick([" ", "\n", ". "]) + lead
        a = len(before.encode())
        out.append((before + mid + tail + pick([" ", "\n", ", "]) + prose(0, 6), a, a + len(mid.encode()), secret))
    return out


@functools.cache
def trained(n: int = FINDINGS, recall: float = RECALL, seed: int = SEED) -> Network:
    """The built-in network; trained once in a process."""
    return train(findings(n, seed), recall, seed=seed)


def _scan(batch: pa.RecordBatch, net: Network) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every slice: its rows, bytes and offsets, and row, first, last and score of its findings."""
    for part in slices(batch, "text"):
        raw, off = text_bytes(part.column("text"))
        row, begin, end = candidates(raw, off)
        score = np.zeros(0)
        if len(row):
            score = net.scores(*windows(raw, off, row, begin, end))
            yes = score >= net.threshold
            row, begin, end, score = row[yes], begin[yes], end[yes], score[yes]
        yield part, raw, off, row, begin, end, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """``doc_id, start_char, end_char, score, digest`` of every secret: places in characters, the
    calibrated probability, and the SHA-256 of the secret in place of the secret."""
    net = net or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off, row, begin, end, score in _scan(batch, net):
                if not len(row):
                    continue
                chars = lambda at, row=row, raw=raw, off=off: np.array([np.count_nonzero((raw[off[r] : a] & 0xC0) != 0x80) for r, a in zip(row, at)], np.int32)
                digest = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(begin, end)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(chars(begin)), pa.array(chars(end)), pa.array(score), pa.array(digest)], ["doc_id", "start_char", "end_char", "score", "digest"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, "doc_id long, start_char int, end_char int, score double, digest string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The same rows, with ``mark`` in place of every secret. ``length_col``, if there is such a
    column, follows the text of the rows that change."""
    net = net or trained()
    names = docs.columns
    length_col = length_col if length_col in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index(text_col))
            at = 0
            for part, raw, off, row, begin, end, _ in _scan(pa.RecordBatch.from_arrays([text], ["text"]), net):
                rows, column = batch.slice(at, part.num_rows), part.column("text")
                at += part.num_rows
                if len(row):
                    texts, changed = column.to_pylist(), np.zeros(len(column), bool)
                    for r in np.unique(row).tolist():
                        kept, here = [], int(off[r])
                        for k in np.flatnonzero(row == r).tolist():
                            kept += [raw[here : begin[k]].tobytes(), mark.encode()]
                            here = int(end[k])
                        texts[r] = b"".join([*kept, raw[here : off[r + 1]].tobytes()]).decode()
                        changed[r] = True
                    arrays = list(rows.columns)
                    arrays[names.index(text_col)] = column = pa.array(texts, column.type)
                    if length_col:
                        k = names.index(length_col)
                        arrays[k] = pa.compute.if_else(pa.array(changed), pa.compute.utf8_length(column).cast(arrays[k].type), arrays[k])
                    rows = pa.RecordBatch.from_arrays(arrays, names)
                yield rows

    return docs.mapInArrow(work, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in documents."""
    return scan(table(spark, sf_dir, "documents"))
