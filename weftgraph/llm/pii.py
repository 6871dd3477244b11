"""Personal data: base patterns plus a skip-chain conditional random field.

Base kinds are found by their patterns (BASE); their tokens are observed with the kind as label. Every other token that
holds a digit, an at sign or "(at)", or repeats the name part of an address, is a node of the field with labels O and the
kinds. Nodes have shape and context features; neighbouring tokens share chain potentials; distant repeated or similar
tokens of a document (see `_keys`) share skip potentials: each occurrence with the next one, and all of them with the
first that a base pattern labels, so that what is known of one mention is one hop from every other. Loopy sum-product
message passing over all nodes of a batch goes on until the messages settle (MAX_ROUNDS at most) and gives marginals. A
node whose best label is a kind with a marginal of MARGIN or more adds a span; neighbours of one kind add one span.

So the field adds what the patterns must drop or cannot see: a phone number that runs into other digits, the second,
shorter mention of a number or an address, a card number with a mistyped digit beside its right form or after a word
that announces it, an address with its at sign spelled out.

Tokens without a digit, at sign or repeated name part have no feature that speaks for a kind; they are observed as O and
texts without nodes are skipped. The weights are fitted by pseudo-likelihood on TRAIN_DOCS generated documents, seeded.

Cases: a null or empty text has no spans; a null id stays null; repeated rows each give a row; other columns are ignored;
an empty table gives no rows; a text of any length is scanned whole, its tokens held only if it has nodes.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import as_bytes, batches, code_point_offsets, join_spans, sliced, with_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
MARGIN = 0.8
TRAIN_DOCS = 800
MAX_ROUNDS, SETTLED = 200, 1e-4
#: Neighbouring tokens with more digits than that are several spans.
MOST_DIGITS = 19
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(rb"[0-9@]|[(\[][Aa][Tt][)\]]")
_SPELLED_AT = re.compile(rb"[A-Za-z0-9][(\[][Aa][Tt][)\]][A-Za-z0-9-]+\.")
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGE = b".,;:!?()[]{}<>\"'|*#%&$"
_NOT_DIGIT = bytes(b for b in range(256) if b not in b"0123456789")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, byte start, byte end), kinds in order and each by start; a failing match still consumes its text."""
    found = []
    if b"@" in raw:
        free = 0
        at = raw.find(b"@")
        while at >= 0:
            start = at
            while start > free and raw[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(raw, at)):
                found.append(("email", start, m.end()))
                free = m.end()
            at = raw.find(b"@", max(at + 1, free))
    for m in _IP.finditer(raw):
        if all(int(p[-4:]) <= 255 and len(p.lstrip(b"0")) <= 3 for p in m[0].split(b".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(raw):
        digits = m[0].translate(None, b" -")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 8 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: Words that announce a kind.
CUES = {
    "email": (b"mail", b"e-mail", b"email", b"contact", b"write"),
    "ip": (b"ip", b"host", b"server", b"address"),
    "card": (b"card", b"visa", b"mastercard", b"credit", b"iban"),
    "phone": (b"phone", b"tel", b"call", b"mobile", b"fax", b"telephone"),
}
_CUE_OF = {w: i for i, k in enumerate(KINDS) for w in CUES[k]}
#: Features of a token by number: the first holds for all, then lengths and shapes, then cues within three tokens before.
_LENGTHS = (1, 4, 7, 10, 12, 16, 20)
_SHAPES = (
    re.compile(rb"[^0-9]*[A-Za-z][^0-9]*"), re.compile(rb"[0-9]+"), re.compile(rb"[^A-Za-z]*[0-9][^A-Za-z]*"), re.compile(rb"[0-9a-f]{20,}"), re.compile(rb"\+[0-9]{1,3}"),
    re.compile(rb"\+[0-9().-]{8,}"), re.compile(rb"\(?[0-9]{2,4}\)"), re.compile(rb"[0-9]{3}[.-][0-9]{4}"), re.compile(rb"\(?[0-9]{3}\)?[.-]?[0-9]{3}[.-][0-9]{4}"),
    re.compile(rb"[0-9]{4}[.-]?([0-9X*]{4}[.-]?){2}[0-9X*]{4}"), re.compile(rb"[0-9]{1,3}([-_,][0-9]{1,3}){3}"), re.compile(rb"[0-9]{1,3}(\.[0-9]{1,3}){2}\.[x*]"),
    re.compile(rb"[0-9]{1,4}[-/.:][0-9]{1,2}([-/.:][0-9]{1,4})?"), re.compile(rb".*@.*"), re.compile(rb"[^@]*[(\[][Aa][Tt][)\]].*\..*"), re.compile(rb"[A-Za-z]+[0-9]{1,3}"), re.compile(rb".*[$%:].*"),
)
_CHECKSUM = 1 + len(_LENGTHS) + len(_SHAPES)
_LINKED = _CHECKSUM + 2
N_FEATURES = _LINKED + 1 + 2 * len(KINDS)


def _features(core: bytes, before: list[bytes], linked: bool) -> list[int]:
    digits = len(core.translate(None, _NOT_DIGIT))
    out = [0]
    if digits:
        out.append(sum(digits >= x for x in _LENGTHS))
    out += [1 + len(_LENGTHS) + i for i, shape in enumerate(_SHAPES) if shape.fullmatch(core)]
    if 15 <= digits <= 19:
        out.append(_CHECKSUM + luhn(core.translate(None, _NOT_DIGIT)))
    if linked:
        out.append(_LINKED)
    for distance, w in enumerate(reversed(before)):
        if (cue := _CUE_OF.get(w.strip(_EDGE).lower())) is not None:
            out.append(_LINKED + 1 + cue + len(KINDS) * (distance > 0))
    return out


def _keys(core: bytes) -> list[tuple[str, bytes]]:
    """What makes tokens of a document similar: the same core, last seven or first eight digits, or name part."""
    found = [("core", core.lower())] if len(core) >= 4 else []
    digits = core.translate(None, _NOT_DIGIT)
    if len(digits) >= 7:
        found.append(("last", digits[-7:]))
    if len(digits) >= 12:
        found.append(("first", digits[:8]))
    if b"@" in core or _SPELLED_AT.search(core):
        found.append(("core", re.split(rb"@|[(\[][Aa][Tt][)\]]", core, maxsplit=1)[0].lower()))
    return found


class Graph:
    """Nodes, features and edges of any number of documents."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.observed: list[int] = []  # label, -1 if hidden
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.spans: list[tuple[int, int, int]] = []  # document, byte start, byte end
        self.token_of: list[int] = []

    def add(self, doc: int, raw: bytes, base: list[tuple[str, int, int]]) -> int:
        """Add a document's nodes; the number of hidden ones."""
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(raw)]
        label = {}
        starts = np.array([s for s, _ in tokens], np.int64)
        for kind, s, e in base:
            i = int(np.searchsorted(starts, s, "right")) - 1
            while i < len(tokens) and tokens[i][0] < e:
                label.setdefault(i, 1 + KINDS.index(kind))
                i += 1
        names = {raw[s:e].split(b"@")[0].lower() for kind, s, e in base if kind == "email"}
        node_at: dict[int, int] = {}
        alike: dict[tuple[str, bytes], list[int]] = {}
        hidden = 0
        for i, (s, e) in enumerate(tokens):
            token = raw[s:e]
            core = token.strip(_EDGE) if token[:1] != b"(" else token.rstrip(_EDGE.replace(b")", b""))
            linked = core.lower() in names
            if not (i in label or linked or _ANY.search(token)):
                continue
            node = len(self.features)
            node_at[i] = node
            self.features.append(_features(core, [raw[a:b] for a, b in tokens[max(0, i - 3) : i]], linked))
            self.observed.append(label.get(i, -1))
            hidden += i not in label
            lead = token.index(core) if core else 0
            self.spans.append((doc, s + lead, s + lead + len(core)))
            self.token_of.append(i)
            if i - 1 in node_at:
                self.chain.append((node_at[i - 1], node))
            for key in _keys(core):
                alike.setdefault(key, []).append(node)
        pairs = set()
        for nodes in alike.values():
            pairs |= {(a, b) for a, b in zip(nodes, nodes[1:], strict=False) if a != b}
            known = next((n for n in nodes if self.observed[n] >= 0), None)
            if known is not None:
                pairs |= {(min(known, n), max(known, n)) for n in nodes if n != known}
        self.skip += sorted(pairs)
        return hidden


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _unary(graph: Graph, weights: np.ndarray) -> np.ndarray:
    flat = np.array([f for fs in graph.features for f in fs])
    owner = np.repeat(np.arange(len(graph.features)), [len(fs) for fs in graph.features])
    score = np.zeros((len(graph.features), len(LABELS)))
    np.add.at(score, owner, weights[flat])
    return score


def marginals(graph: Graph, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Loopy sum-product with damping, all documents at once; exact where the edges make no loop."""
    score = _unary(graph, weights)
    observed = np.array(graph.observed)
    seen = np.flatnonzero(observed >= 0)
    score[seen] = -50.0
    score[seen, observed[seen]] = 0.0
    edges = [*graph.chain, *graph.skip]
    if edges:
        a, b = np.array(edges).T
        pair = np.where((np.arange(len(edges)) < len(graph.chain))[:, None, None], chain, skip)
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(MAX_ROUNDS):
            belief = score.copy()
            np.add.at(belief, target, message)
            new = _logsumexp((belief[source] - message[back])[:, :, None] + pair, 1)
            new -= _logsumexp(new, 1)[:, None]
            moved = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if moved < SETTLED:
                break
        np.add.at(score, target, message)
    return np.exp(score - _logsumexp(score, 1)[:, None])


def _generated(rng: random.Random) -> tuple[bytes, list[tuple[int, int, int]]]:
    """A document of filler and entities, and (label, start, end) of all mentions, base and loose ones."""
    syllables = ("ta", "re", "on", "mi", "lu", "es", "ke", "an", "or", "vi", "du", "sha", "ño", "ü", "é")
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    plain = lambda: "".join(rng.choices(syllables[:12], k=rng.randint(2, 3)))
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    pick = lambda *some: rng.choice(some)

    def card() -> str:
        body = pick("3", "4", "5", "6") + number(14)
        return next(body + c for c in "0123456789" if luhn((body + c).encode()))

    def mentions(kind: int) -> list[tuple[str, int]]:
        """A full mention, which the patterns mostly find, and loose ones, which they do not."""
        if kind == 1:
            name = pick(f"{plain()}.{plain()}", plain() + number(2), f"{plain()}_{plain()}")
            host = f"{plain()}{pick('', number(1))}.{pick('example.com', 'org', 'net')}"
            full, loose = f"{name}@{host}", [name, name, f"{name}{pick('(at)', '[at]')}{host}"]
        elif kind == 2:
            four = [str(rng.randint(1, 255)) for _ in range(4)]
            full, loose = ".".join(four), ["-".join(four), "_".join(four), ",".join(four)]
        elif kind == 3:
            n = card()
            wrong = n[:-1] + str((int(n[-1]) + rng.randint(1, 9)) % 10)
            full = pick(n, n, "-".join(n[i : i + 4] for i in range(0, 16, 4)), " ".join(n[i : i + 4] for i in range(0, 16, 4)))
            loose = [f"x{n}", n[:-1] + pick("X", "*"), wrong, "-".join(wrong[i : i + 4] for i in range(0, 16, 4))]
        else:
            a, b, c = number(3), number(3), number(4)
            full = pick(f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}", f"+{number(2)} {a} {b}{c}")
            loose = [f"{b}-{c}", f"({a}) {b}-{c}", f"{a}{b}{c}", f"{a}-{b}-{c}", f"{b}{c}", f"{a}.{b}.{c}"]
        shape = rng.random()
        if shape < 0.5:
            return [(full, kind)] + [(pick(*loose), kind) for _ in range(rng.randint(1, 3))]
        if shape < 0.7:
            return [(full, kind)] * rng.randint(1, 2)
        if kind == 4 and shape < 0.85:  # runs into digits, so the pattern takes too many and is dropped
            return [(f"+1 ({a}) {b}-{c}", 4), ("\0", 0), (pick(".".join(str(rng.randint(1, 255)) for _ in range(4)), number(rng.randint(5, 12))), -1)]
        if kind == 3 and shape < 0.85:
            return [(pick(number(16), number(8)), 0), ("\0", 0), (n, 3)]
        if kind == 4:
            return [(pick(f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}"), 4)]
        cue = pick(*CUES[KINDS[kind - 1]]).decode()
        return [(f"{cue}{pick(':', '', ' no.')}", 0), ("\0", 0), (pick(*loose[1:]) if kind != 1 else loose[-1], kind)]

    decoys = [
        lambda: number(rng.randint(1, 6)), lambda: f"{number(1)}.{number(1)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}",
        lambda: number(pick(8, 9, 10, 12)), lambda: number(16), lambda: f"${number(2)}.{number(2)}", lambda: f"v{number(1)}.{number(1)}.{number(1)}",
        lambda: "".join(rng.choices("0123456789abcdef", k=pick(32, 40))), lambda: f"{number(3)}%", lambda: f"@{plain()}", lambda: f"{plain()}{number(2)}", lambda: f"{number(2)}/{number(2)}/{number(4)}",
    ]
    items: list[list[tuple[str, int]]] = []
    for kind in rng.sample(range(1, 5), rng.randint(0, 3)):
        some = mentions(kind)
        at = 0
        while at < len(some):  # what a zero byte joins stays together, the rest is scattered
            n = 3 if at + 1 < len(some) and some[at + 1][0] == "\0" else 1
            items.append([x for x in some[at : at + n] if x[0] != "\0"])
            at += n
    for _ in range(rng.randint(2, 8)):
        text = pick(*decoys)()
        items += [[(text, 0)]] * (2 if rng.random() < 0.25 else 1)
    rng.shuffle(items)
    out, spans = "", []
    for item in items:
        out += "".join(word() + pick(" ", " ", ", ", ". ", "\n") for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.3 and item[0][1] > 0:
            out += pick(*CUES[KINDS[item[0][1] - 1]]).decode() + pick(" ", ": ")
        for text, kind in item:
            if kind > 0:
                spans.append((kind, len(out.encode()), len((out + text).encode())))
            elif kind < 0 and "." in text:
                spans.append((2, len(out.encode()), len((out + text).encode())))
            out += text + " "
        out = out[:-1] + pick(" ", " ", ", ", ". ")
    return out.encode(), spans


def generated_graph(seed: int, docs: int) -> tuple[Graph, np.ndarray]:
    """Nodes of generated documents and their true labels."""
    rng = random.Random(seed)
    graph, truth = Graph(), []
    for d in range(docs):
        raw, spans = _generated(rng)
        first = len(graph.spans)
        graph.add(d, raw, base_spans(raw))
        for _, s, e in graph.spans[first:]:
            truth.append(next((k for k, a, b in spans if a < e and s < b), 0))
    return graph, np.array(truth)


@lru_cache(1)
def fitted(seed: int = 7, docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature weights, chain and skip potentials by pseudo-likelihood: each label given its neighbours' labels."""
    graph, truth = generated_graph(seed, docs)
    n, size = len(truth), len(LABELS)
    one = np.eye(size)[truth]
    x = np.zeros((n, N_FEATURES))
    for i, fs in enumerate(graph.features):
        x[i, fs] = 1
    before, after, skips = np.zeros((n, size)), np.zeros((n, size)), np.zeros((n, size))
    for a, b in graph.chain:
        after[a] += one[b]
        before[b] += one[a]
    for a, b in graph.skip:
        skips[a] += one[b]
        skips[b] += one[a]
    hidden = np.array(graph.observed) < 0
    x, before, after, skips, one = (m[hidden] for m in (x, before, after, skips, one))
    w, chain, skip = np.zeros((N_FEATURES, size)), np.zeros((size, size)), np.zeros((size, size))
    for step in range(400):
        score = x @ w + before @ chain + after @ chain.T + skips @ skip
        error = one - np.exp(score - _logsumexp(score, 1)[:, None])
        rate = 4.0 / (1 + step / 100) / len(one)
        w += rate * (x.T @ error - 0.1 * w)
        chain += rate * (before.T @ error + (after.T @ error).T - 0.1 * chain)
        grad = skips.T @ error
        skip += rate * ((grad + grad.T) / 2 - 0.1 * skip)
    return w, chain, skip


def added_spans(graph: Graph, belief: np.ndarray, texts: list[bytes]) -> list[tuple[int, str, int, int]]:
    """(document, kind, byte start, byte end) of hidden nodes with a sure kind; neighbours of one kind make one span."""
    best = belief.argmax(axis=1)
    sure = np.flatnonzero((best > 0) & (np.array(graph.observed) < 0) & (belief.max(axis=1) >= MARGIN))
    found: list[tuple[int, str, int, int]] = []
    last = (-1, -1, -1)
    for i in sure.tolist():
        d, s, e = graph.spans[i]
        if s == e:
            continue
        here = (d, graph.token_of[i], int(best[i]))
        joins = here == (last[0], last[1] + 1, last[2]) and not texts[d][found[-1][3] : s].strip()
        if joins and len(texts[d][found[-1][2] : e].translate(None, _NOT_DIGIT)) <= MOST_DIGITS:
            found[-1] = (*found[-1][:3], e)
        else:
            found.append((d, LABELS[best[i]], s, e))
        last = here
    return found


SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def _scanner(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batch_iter):
            texts = as_bytes(b.column("text"))
            base = [base_spans(raw) if _ANY.search(raw) else [] for raw in texts]
            graph = Graph()
            hidden = sum(graph.add(d, raw, base[d]) for d, raw in enumerate(texts) if _ANY.search(raw))
            added: dict[int, list[tuple[str, int, int]]] = {}
            if hidden:
                for d, k, s, e in added_spans(graph, marginals(graph, *model), texts):
                    if not any(x < e and s < y for _, x, y in base[d]):
                        added.setdefault(d, []).append((k, s, e))
            rows: dict[str, list] = {f.name: [] for f in schema}
            rows["doc_id"] = b.column("doc_id").to_pylist()
            for d, raw in enumerate(texts):
                every = [*base[d], *added.get(d, [])]
                if every:
                    cp = code_point_offsets(raw, [x for _, s, e in every for x in (s, e)])
                    every = [(k, cp[2 * i], cp[2 * i + 1]) for i, (k, _, _) in enumerate(every)]
                mine = every[: len(base[d])]
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(x[0] == k for x in mine))
                rows["base_sha256"].append(hashlib.sha256(join_spans(mine).encode()).hexdigest())
                rows["spans"].append(join_spans(sorted(every, key=lambda x: (KINDS.index(x[0]), x[1]))))
            yield batches(rows, schema)

    return run


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    return with_text(df, id_col, text_col).mapInArrow(_scanner(fitted()), SCHEMA)
