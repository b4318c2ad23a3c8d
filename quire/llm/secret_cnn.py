"""Secret scans: fixed patterns, and a character convolutional network over
every other candidate with its surrounding context.

Base findings are those of three patterns. Candidates that no base finding
meets are runs of 16 or more secret-like characters with a letter and a digit or
with two changes from small to capital letters (dots inside count, so a web token
of three parts is one), passwords inside an address (`://user:password@`), and values of 8 or
more characters with a letter and a digit after a key's name and `:` or `=`.
The network (numpy; embedded characters, one convolution, max pooling, a dense
layer) reads a candidate with the characters around it; a candidate longer
than the window is read in overlapping windows and takes the largest score, so
no part is left out. It is trained on labelled findings: base findings and
plain candidates of all texts, and findings written from
public token formats and from common harmless ones. Nobody has labelled the
texts' candidates, so those that look like tokens (known prefixes, a key's name
before them, characters as if drawn at random) are no examples of either class.
The texts' distinct findings are dealt by their hash into shards of about SHARD.
In each epoch every shard goes on from the same weights, over its own and the
written findings, and the shards' weights are averaged, each by its findings; so
training is spread over the tasks, and the network does not
depend on how the table is stored. Harmless formats include UUIDs, ISBNs, data
addresses, names in mixed case, host names and versions. Scores are calibrated (a logistic fit of the network's output on all held-out
findings, those of the texts counted by output in steps of 1 / STEPS), and the
threshold is the largest that still finds the required share
of held-out secrets of each format.

The trained weights are a few thousand numbers and go to every task; texts are
neither shuffled nor collected, and findings are not collected.

Defined results: a null or empty text has no findings; a null id stays null;
repeated rows each give a row; an empty table gives no rows (the network is
then trained on the written findings alone); other columns are not read.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, doc_text, map_arrow

KINDS = ("assign", "access", "hex")
#: Kind of the network's findings.
FOUND = "cnn"
#: Written findings of a class; findings of the texts in one shard, as expected.
WRITTEN, SHARD = 5_000, 20_000
#: Outputs are counted in steps of 1 / STEPS, between -REACH and REACH.
STEPS, REACH = 256, 128
#: Share of held-out secrets of each format that the threshold must find, and further written findings of a class that are held out for it.
RECALL, CHECKED = 0.98, 3_000
EPOCHS = 10
BEFORE, BODY, AFTER = 24, 48, 8
WINDOW = BEFORE + BODY + AFTER
EMBED, WIDTH, FILTERS, HIDDEN = 12, 5, 24, 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]")
_ADDRESS = re.compile(r"://[^\s:/@]{0,256}:([^\s/@]{4,256})@")
_VALUE = re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{7,}[A-Za-z0-9+/_=-])""", re.IGNORECASE | re.ASCII)
_NAMES = ("pass", "pwd", "secret", "token", "key", "credential")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
#: A capital after a small letter, twice.
_MIXED = re.compile(r"[a-z][A-Z].*[a-z][A-Z]")
_PREFIX = re.compile(r"gh[opsur]_|github_pat_|xox[abeoprs]-|[spr]k_(?:live|test)_|glpat-|AIza|AKIA|ASIA|eyJ|npm_|pypi-|hf_|sk-|SG\.|ya29")
_KEY_NAME = re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth[a-z]*|bearer|credentials?|signature)[A-Za-z_-]*["']?\x20*(?:[:=]\x20*|\x20)["']?(?:bearer\x20)?\Z""", re.IGNORECASE | re.ASCII)
#: Share of places where lower case, capitals and digits change; 0.6 in random letters and digits, under 0.2 in words with numbers.
CHANGES = 0.3
_WORDS = ("password", "passwd", "secret", "token", "api")
#: Bytes of lower-case hex digits become x.
_HEX_MAP = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then by the kinds' order."""
    spans = []
    raw = text.encode()
    low = raw.lower()
    if any(w.encode() in low for w in _WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"x" * 16 in raw.translate(_HEX_MAP):
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates that meet no base finding, by start; where two meet, the first found of addresses, runs and values."""
    found = []
    if "://" in text:
        found += [m.span(1) for m in _ADDRESS.finditer(text)]
    digits = _DIGIT.search(text) is not None
    for m in _RUN.finditer(text):
        run = m[0]
        if (digits and _DIGIT.search(run) and _LETTER.search(run)) or _MIXED.search(run):
            found.append(m.span())
    low = text.lower()
    if digits and any(name in low for name in _NAMES):
        found += [m.span(1) for m in _VALUE.finditer(text) if _DIGIT.search(m[1]) and _LETTER.search(m[1])]
    taken: list[tuple[int, int]] = []  # spans that do not meet, in order
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in found:
        at = bisect.bisect_left(taken, (b,))
        if not at or taken[at - 1][1] <= a:
            taken.insert(at, (a, b))
            out.append((a, b))
    return sorted(out)


def token_like(text: str, start: int, end: int) -> bool:
    """Whether a candidate may well be a secret: by its prefix, by what precedes it, or as its characters change like random ones."""
    run = text[start:end]
    if _PREFIX.search(run) or _KEY_NAME.search(text[max(0, start - BEFORE) : start]) or ("=" in run and _KEY_NAME.search(run[: run.index("=") + 1])):
        return True
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in run if c.isalnum()]
    # any stretch as long as the shortest candidate counts, so words around a token do not hide it
    changed = np.concatenate([[0], np.cumsum([a != b for a, b in zip(kinds, kinds[1:])])])
    reach = min(15, len(kinds) - 1)
    return bool(reach > 0 and (changed[reach:] - changed[:-reach]).max() >= CHANGES * reach)


def windows(text: str, start: int, end: int) -> list[bytes]:
    """A candidate in its context: windows that together cover all of it; other characters than ASCII count as one."""
    out = []
    for at in range(start, max(start + 1, end - BODY + BODY // 2), BODY // 2):
        body = text[at : min(at + BODY, end)]
        before = text[max(0, at - BEFORE) : at]
        after = text[min(at + BODY, end) : min(at + BODY, end) + AFTER]
        joined = before.rjust(BEFORE, "\0") + body.ljust(BODY, "\0") + after.ljust(AFTER, "\0")
        out.append(joined.encode("ascii", "replace"))
        if at + BODY >= end:
            break
    return out


class Network:
    """Embedding, convolution, max pooling, a hidden layer, one output."""

    def __init__(self, weights: dict[str, np.ndarray], scale: tuple[float, float] = (1.0, 0.0), threshold: float = 0.5) -> None:
        self.weights, self.scale, self.threshold = weights, scale, threshold

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda n, *shape: r.normal(0, (2 / n) ** 0.5, shape).astype(np.float32)
        return cls(
            {
                "embed": (r.normal(0, 0.5, (128 * 3, EMBED))).astype(np.float32),
                "conv": draw(WIDTH * EMBED, WIDTH * EMBED, FILTERS),
                "conv_bias": np.zeros(FILTERS, np.float32),
                "dense": draw(3 * FILTERS, 3 * FILTERS, HIDDEN),
                "dense_bias": np.zeros(HIDDEN, np.float32),
                "out": draw(HIDDEN, HIDDEN, 1),
                "out_bias": np.zeros(1, np.float32),
            }
        )

    #: Symbols: a character's code, by where it stands: before, in, or after the candidate.
    PLACE = np.repeat([0, 128, 256], [BEFORE, BODY, AFTER])
    #: Convolution places pooled together: before, in and after the candidate.
    POOLS = ((0, BEFORE - 2), (BEFORE - 2, BEFORE + BODY - 2), (BEFORE + BODY - 2, WINDOW - WIDTH + 1))

    def forward(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        symbols = np.minimum(codes, 127).astype(np.int64) + self.PLACE
        x = w["embed"][symbols]
        patches = np.lib.stride_tricks.sliding_window_view(x, WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(codes), -1, WIDTH * EMBED)
        conv = np.maximum(patches @ w["conv"] + w["conv_bias"], 0)
        arg = np.stack([conv[:, a:b].argmax(1) + a for a, b in self.POOLS], 1)
        pooled = np.take_along_axis(conv, arg, 1)
        flat = pooled.reshape(len(codes), -1)
        hidden = np.maximum(flat @ w["dense"] + w["dense_bias"], 0)
        return {"symbols": symbols, "patches": patches, "arg": arg, "pooled": pooled, "flat": flat, "hidden": hidden, "logit": (hidden @ w["out"] + w["out_bias"])[:, 0]}

    def gradients(self, codes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(codes)
        d = ((1 / (1 + np.exp(-f["logit"])) - truth) / len(codes)).astype(np.float32)[:, None]
        g = {"out": f["hidden"].T @ d, "out_bias": d.sum(0)}
        d = (d @ w["out"].T) * (f["hidden"] > 0)
        g |= {"dense": f["flat"].T @ d, "dense_bias": d.sum(0)}
        d = (d @ w["dense"].T).reshape(f["pooled"].shape) * (f["pooled"] > 0)
        g |= {"conv": np.zeros_like(w["conv"]), "conv_bias": d.sum((0, 1)), "embed": np.zeros_like(w["embed"])}
        rows = np.arange(len(codes))[:, None, None]
        picked = f["patches"][rows, f["arg"]]  # rows, pools, filters, patch
        g["conv"] = np.einsum("npfk,npf->kf", picked, d)
        back = np.einsum("npf,kf->npfk", d, w["conv"]).reshape(*d.shape, WIDTH, EMBED)
        at = f["arg"][..., None] + np.arange(WIDTH)
        np.add.at(g["embed"], f["symbols"][rows[..., None], at], back)
        return g

    def state(self) -> np.ndarray:
        """What an epoch starts from: the weights, the two means of their gradients, and the steps so far."""
        weights = np.concatenate([v.ravel() for v in self.weights.values()]).astype(np.float64)
        return np.concatenate([weights, np.zeros(2 * len(weights) + 1)])

    def restore(self, state: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
        """Takes the weights of a state; the two means and the steps are returned."""
        cuts = np.cumsum([v.size for v in self.weights.values()] * 3)
        parts = iter(np.split(state[:-1].astype(np.float32), cuts[:-1]))
        self.weights, first, second = ({k: next(parts).reshape(v.shape) for k, v in self.weights.items()} for _ in range(3))
        return first, second, float(state[-1])

    def epoch(self, state: np.ndarray, codes: np.ndarray, truth: np.ndarray, seed: list[int], rate: float = 3e-3, batch: int = 64) -> np.ndarray:
        """The state after one pass over the findings."""
        first, second, step = self.restore(state)
        order = np.random.default_rng(seed).permutation(len(codes))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            for k, g in self.gradients(codes[some], truth[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return np.concatenate([*(v.ravel() for part in (self.weights, first, second) for v in part.values()), [step]]).astype(np.float64)

    def calibrate(self, codes: np.ndarray, truth: np.ndarray, recall: float, formats: np.ndarray | None = None, counted: tuple[np.ndarray, ...] | None = None) -> None:
        """A logistic fit of the output on held-out findings, then the largest threshold with the required recall in each format.
        `counted`: outputs of further findings, their truth and their number; they are of format -1."""
        z = self.logits(codes)
        formats = np.zeros(len(codes), np.int64) if formats is None else formats
        n = np.ones(len(codes))
        if counted is not None:
            z, truth, n = (np.concatenate(c) for c in zip((z, truth, n), counted, strict=True))
            formats = np.append(formats, np.full(len(counted[0]), -1))
        a, b = 1.0, 0.0
        mean = lambda x: float((x * n).sum() / n.sum())
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.1 * mean((p - truth) * z) / max(1.0, mean(z * z)), b - 0.1 * mean(p - truth)
        self.scale = (a, b)
        scores = self.scaled(z)
        least = []
        for f in np.unique(formats[truth == 1]):
            good = np.flatnonzero((truth == 1) & (formats == f))
            good = good[np.argsort(scores[good], kind="stable")]
            upto = np.cumsum(n[good])
            least.append(float(scores[good[np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")]]))
        self.threshold = min(least, default=0.5)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[i : i + 512])["logit"] for i in range(0, len(codes), 512)]
        return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)

    def scaled(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(codes))


def coded(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), WINDOW)


def written(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, truth): findings written from public formats of tokens, and harmless look-alikes."""
    return [row[:4] for row in with_formats(seed, n)]


def with_formats(seed: int, n: int) -> list[tuple[str, int, int, int, int]]:
    """The written findings and the number of each one's format in its class."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k, chars=alnum: "".join(r.choice(chars) for _ in range(k))
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode()
    cased = lambda t: t.upper() if r.random() < 0.3 else t
    password = lambda: "".join(r.sample("abcdefghjkmnpqrstuvwxyz", 2) + r.sample("23456789", 2) + [r.choice(alnum) for _ in range(r.randint(4, 11))])
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "or", "ti", "de", "es", "la", "ch", "qu", "ver", "ung")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 8)))
    secrets = (
        lambda: "ghp_" + some(36),
        lambda: "xoxb-" + some(12, "0123456789") + "-" + some(24),
        lambda: "sk_live_" + some(24),
        lambda: "glpat-" + some(20),
        lambda: "AIza" + some(35, alnum + "-_"),
        lambda: "eyJ" + some(r.randint(30, 120), alnum + "-_"),
        lambda: some(r.choice((20, 24, 32, 40, 64))),
        lambda: b64(r.choice((16, 24, 32, 48))),
        lambda: some(r.choice((32, 40, 64)), "0123456789ABCDEF"),
        lambda: ".".join(("eyJ" + some(r.randint(15, 40), alnum + "-_"), "eyJ" + some(r.randint(20, 80), alnum + "-_"), some(43, alnum + "-_"))),
        lambda: "SG." + some(22, alnum + "-_") + "." + some(43, alnum + "-_"),
        lambda: some(r.choice((20, 24, 32, 40)), alnum[:52]),
        lambda: (f"{r.choice(('postgres', 'mysql', 'mongodb', 'redis', 'amqp', 'https'))}://{word()}:", password(), f"@{word()}.{word()}/{word()}"),
        lambda: (f"{r.choice(('password', 'passwd', 'pwd', 'secret', 'db_pass', 'API_KEY', 'token'))}{r.choice(('=', ': ', ' = '))}", password(), ""),
    )
    harmless = (
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 99)}",
        lambda: "/".join([word(), word(), str(r.randint(1990, 2030)), word(), word()]),
        lambda: word() + word() + word() + word() + str(r.randint(0, 9999)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}Z",
        lambda: f"v{r.randint(0, 9)}-{r.randint(0, 99)}-{r.randint(0, 99)}-{word()}-{word()}",
        lambda: "=" * r.randint(8, 30) + word() + str(r.randint(0, 9)) + "=" * r.randint(4, 30),
        lambda: f"{word()}{r.randint(0, 9)}" * r.randint(4, 8),
        lambda: cased(str(uuid.UUID(int=r.getrandbits(128)))),
        lambda: ("", cased(str(uuid.UUID(int=r.getrandbits(128)))), r.choice(("", ".", ","))),
        lambda: f"{r.choice(('ISBN', 'isbn-', '', 'ISSN'))}978-{r.randint(0, 9)}-{r.randint(10, 9999)}-{r.randint(1000, 99999)}-{r.choice('0123456789X')}",
        lambda: (f"data:{r.choice(('image/png', 'image/gif', 'image/jpeg', 'font/woff2'))};base64,", r.choice(("iVBORw0KGgo", "R0lGODlh", "/9j/4AAQ", "d09GMg")) + b64(r.randint(24, 90)), ""),
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 7))),
        lambda: (r.choice(("", f"{word()}.{r.randint(1, 99)}@", f"{word()}@", "https://")), f"{r.choice((word(), 'mail', 'mx', 'ns'))}{r.randint(1, 20)}.{word()}{word()}.{r.choice(('com', 'org', 'net', 'de'))}", ""),
        lambda: f"www.{word()}{word()}.{r.choice(('com', 'org', 'net'))}/{word()}/{word()}{r.randint(0, 999)}",
        lambda: f"{word()}.{word()}.{word().capitalize()}{word().capitalize()}.{word()}{r.randint(0, 9)}",
        lambda: f"{word()}-{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}-{r.choice(('linux-x86_64', 'py3-none-any.whl', 'beta.2.tar.gz', 'amd64.deb'))}",
        lambda: (f"{r.choice(('key', 'token', 'password', 'secret', 'key'))}{r.choice(('=', ': ', ' = '))}", f"{word()}{word()}{r.choice('_-')}{r.randint(0, 99)}", ""),
    )
    leads = ("", "", "", "key ", "Authorization: Bearer ", "auth=", "credential: ", "x-auth ")
    out = []
    for k in range(2 * n):
        truth = k % 2
        formats = secrets if truth else harmless
        make = r.choice(formats)
        made = make()
        lead, body, tail = made if isinstance(made, tuple) else (r.choice(leads) if truth or r.random() < 0.3 else "", made, "")
        before = f"{prose()} {lead}".lstrip()
        out.append((f"{before}{body}{tail} {prose()}", len(before), len(before) + len(body), truth, formats.index(make)))
    return out


def _labelled(batches):
    """(window, truth) of base findings' values and of other candidates that do not look like tokens."""
    for batch in batches:
        rows = set()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for start, end, kind in base:
                if kind == "assign":  # the value, as the network is to know values
                    start = _ASSIGN.match(text, start).start(2)
                rows |= {(w, 1) for w in windows(text, start, end)[:1]}
            rows |= {(w, 0) for a, b in candidates(text, base) if not token_like(text, a, b) for w in windows(text, a, b)[:1]}
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["window", "truth"])


def _of_shard(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and truth of a shard's findings, in the order of their windows."""
    found = sorted(zip(rows["window"].to_pylist(), rows["truth"].to_pylist(), strict=True))
    return coded([w for w, _ in found]), np.array([t for _, t in found], np.float32)


def _epoch(network: Network, state: np.ndarray, codes: np.ndarray, truth: np.ndarray, seed: list[int]):
    """(shard, n, state) after an epoch over a shard's findings and the written ones."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own, true = _of_shard(rows)
        after = network.epoch(state, np.concatenate([own, codes]), np.concatenate([true, truth]), [*seed, key[0].as_py()])
        return pa.table({"shard": [key[0].as_py()], "n": [len(own)], "state": [after.tobytes()]})

    return run


def _outputs(network: Network):
    """(truth, step, n): a shard's findings by their outputs."""

    def run(rows: pa.Table) -> pa.Table:
        codes, truth = _of_shard(rows)
        step = np.floor(np.clip(network.logits(codes), -REACH, REACH) * STEPS).astype(np.int64)
        found, n = np.unique(np.stack([truth.astype(np.int64), step], 1), axis=0, return_counts=True)
        return pa.table({"truth": found[:, 0], "step": found[:, 1], "n": n})

    return run


def trained(docs: DataFrame, sample_docs: int | None = None, recall: float = RECALL, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network trained on the findings of all texts and on written ones;
    with `sample_docs`, on those of so many texts, as expected."""
    rows = doc_text(docs, id_col, text_col)
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(rows.count(), 1))
        # drawn by what a row holds, so the same rows in other files give the same network
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    scratch = Scratch(docs.sparkSession, "secret-findings")
    labelled = scratch.stored(map_arrow(rows.select("text"), _labelled, "window binary, truth long").distinct(), "found")
    shards = max(1, -(-labelled.count() // SHARD))
    held_out = F.conv(F.substring(F.md5("window"), 1, 2), 16, 10).cast("int") % 4 == 0
    findings = scratch.stored(labelled.select("window", "truth", F.pmod(F.xxhash64("window"), F.lit(shards)).alias("shard"), held_out.alias("held_out")), "shards")
    # shards are small in bytes and long to train on, so tasks are not merged by size
    training = findings.where(~F.col("held_out")).repartition(shards, "shard").groupBy("shard")

    more = [(windows(t, a, b)[0], truth) for t, a, b, truth in written(seed, WRITTEN)]
    codes, truth = coded([w for w, _ in more]), np.array([t for _, t in more], np.float32)
    held = np.array([hashlib.md5(w).digest()[0] % 4 == 0 for w, _ in more])
    network = Network.fresh(seed)
    state = network.state()
    for k in range(EPOCHS):
        step = _epoch(network, state, codes[~held], truth[~held], [seed, k])
        done = sorted(training.applyInArrow(step, "shard long, n long, state binary").collect())
        if done:
            state = np.average([np.frombuffer(r.state) for r in done], axis=0, weights=[r.n for r in done])
        else:
            state = network.epoch(state, codes[~held], truth[~held], [seed, k])
    network.restore(state)

    outputs = findings.where("held_out").repartition(shards, "shard").groupBy("shard").applyInArrow(_outputs(network), "truth long, step long, n long")
    counts = sorted(outputs.groupBy("truth", "step").agg(F.sum("n").alias("n")).collect())
    counted = np.array([r.step / STEPS for r in counts]), np.array([r.truth for r in counts], np.float32), np.array([r.n for r in counts], np.float64)
    scratch.drop(labelled, findings)
    check = with_formats(seed + 1, CHECKED)
    formats = np.concatenate([np.full(int(held.sum()), -1), [f for *_, f in check]])  # -1: those of the texts and of training, as one
    network.calibrate(np.concatenate([codes[held], coded([windows(t, a, b)[0] for t, a, b, *_ in check])]), np.concatenate([truth[held], [t for *_, t, _ in check]]), recall, formats, counted)
    return network


def scanned(text: str, base: list[tuple[int, int, str]], network: Network) -> list[tuple[int, int, str, float]]:
    """The network's findings in one text, with their scores."""
    runs = candidates(text, base)
    if not runs:
        return []
    parts = [windows(text, a, b) for a, b in runs]
    scores = network.scores(coded([w for p in parts for w in p]))
    best = np.maximum.reduceat(scores, np.cumsum([0, *(len(p) for p in parts[:-1])]))
    return [(a, b, FOUND, float(s)) for (a, b), s in zip(runs, best, strict=True) if s >= network.threshold]


SCHEMA = "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>, text string"


def found_spans(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (start, end, kind, score; by start, then kind) and the text with every span replaced."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
    order = {k: i for i, k in enumerate((*KINDS, FOUND))}

    def run(batches):
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = sorted([(a, b, k, 1.0) for a, b, k in base] + scanned(text, base, network), key=lambda s: (s[0], order[s[2]]))
                spans.append([dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in every])
                clean.append(redacted(text, every))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(clean, pa.string())], ["doc_id", "spans", "text"])

    return map_arrow(doc_text(docs, id_col, text_col), run, SCHEMA)


def without_secrets(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with every secret in the text replaced; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                clean.append(text and redacted(text, sorted([*base, *scanned(text, base, network)], key=lambda s: s[:2])))
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple]) -> str:
    """The text with each stretch of spans that meet replaced by one mark."""
    if not spans:
        return text
    out, at = [], 0
    reach = 0
    for start, end, *_ in spans:
        if start >= reach:
            out += [text[at:start], "[SECRET]"]
        reach = max(reach, end)
        at = reach
    return "".join(out) + text[at:]
