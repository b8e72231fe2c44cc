"""Secret scan: fixed patterns, and character Markov models for the rest.

The patterns of PATTERNS give the base spans, leftmost and non-overlapping
per kind. Tokens of ``LEAST_TOKEN`` characters or more that no base span
touches are judged by the log-likelihood ratio of two second-order character
models, one of random strings and one of ordinary identifiers; those whose
ratio reaches the limit are reported as ``random``, whatever letters or digits
they are made of.

Both models are trained from labelled samples, each distinct string once, so
copies of a document weigh nothing:

* random: the secret parts of all base spans, and strings drawn evenly from
  the alphabets of usual keys (:func:`drawn`);
* ordinary: every token outside the base spans that occurs in two or more
  documents, and the identifiers of NAMES, weighted to ``NAMES_SHARE``.

A model has the chance of each character (letters without case) after the two
before it, and of a capital after the classes of the two before it; contexts
that were seen seldom lean on the shorter ones. Tokens of the shapes in
ORDINARY (UUIDs, plain and coded numbers) are labelled ordinary by their shape
and never judged.

One in ``HELD_OUT`` strings of either label (by their hash) trains nothing.
The limit is the least ratio that at most ``MOST_FALSE`` of the held-out
ordinary strings reach, but ``LEAST_RATIO`` at least; :class:`Ratio` keeps
both error rates found there.

Passes over the texts: one gathers the samples (summed per distinct string),
one scans. Counts of either model are two tables of fixed size; a task holds
one document and these tables.

Defined cases: a null or empty text has no spans. Repeated rows and null ids
are scanned row by row. Very long texts are scanned whole, and so is a token
of any length. Of base spans that overlap, each kind keeps its own; a token
that ties with the limit is reported. An empty table gives an empty result;
the models are then those of the fixed samples. Columns besides id and text
are not read by :func:`scan`, whatever their names; :func:`redact` keeps them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import batches, documents, id_and_text, stage, texts

#: Kind, pattern, group that holds the secret, least length of
#: that group. Letters of ``assign`` match in either case.
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                          r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+(?<=[0-9a-f]{24})"), 0, 24),
]
KINDS = [kind for kind, *_ in PATTERNS] + ["random"]
#: A token is a whole run of these; shorter ones give the ratio too few steps.
LEAST_TOKEN = 8
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN)
#: Shapes of ordinary identifiers, as labels: UUIDs, numbers
#: with separators (x as in 12x34), numbers with a short letter code before
#: them.
ORDINARY = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+"
                      r"|[A-Za-z]{0,5}[_/-]?[0-9]+([_/x-][0-9]+)*|[+/_=-]+[a-z]*[+/_=-]*")
#: Labelled samples of ordinary identifiers.
NAMES = """
utf8mb4_unicode_ci utf8mb4_general_ci latin1_swedish_ci max_connections innodb_buffer_pool_size user_account_id
created_at_timestamp updated_by_user is_deleted_flag order_line_items customer_address_line2 shipping_method_code
total_amount_excl_tax default_charset content_type content_length access_control_allow_origin x_forwarded_for
if_modified_since last_login_date primary_key_constraint foreign_key_checks auto_increment_offset read_only_replica
getElementById addEventListener removeEventListener querySelectorAll innerHTML documentElement backgroundColor
borderRadius fontFamily setTimeout clearInterval XMLHttpRequest encodeURIComponent parseFloat toUpperCase
toLocaleString hasOwnProperty isPrototypeOf createElement appendChild StringBuilder ArrayList HashMap LinkedHashSet
NullPointerException IllegalArgumentException ConcurrentModificationException FileNotFoundException IOException
BufferedReader InputStreamReader ObjectOutputStream ThreadPoolExecutor AbstractFactoryBean ApplicationContext
HttpServletRequest userAccountId createdAtTimestamp orderLineItems customerAddress shippingMethodCode totalAmount
MAX_BUFFER_SIZE DEFAULT_TIMEOUT_MS HTTP_STATUS_OK LOG_LEVEL_DEBUG ENABLE_FEATURE_FLAG DATABASE_URL READ_TIMEOUT
ABCDEFGHIJ ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789abcdef qwertyuiop asdfghjkl
x86_64-linux-gnu amd64-unknown-linux arm64-v8a i686-pc-windows win32-x64 python3-dev libssl-dev lib64-gcc
sha256sum md5checksum base64encode utf16le iso8859-1 windows-1252 http2-server ipv6-address mp3-player h264-codec
node_modules package-lock index-html main-content nav-bar-item side-bar-left btn-primary btn-outline-secondary
col-md-12 col-sm-offset-2 font-size-14px margin-top-20px z-index-100 text-align-center display-inline-block
release-2024-03-15 version-1-2-3 build-20240315-1 chapter-12-section-3 page-not-found step-by-step state-of-the-art
well-known-types long-term-support end-to-end-testing src/main/java src/test/resources usr/local/bin etc/nginx/conf
home/user/documents api/v1/users api/v2/orders assets/images/logo wp-content/uploads var/log/messages static/css/main
""".split()
#: Share of the ordinary model's steps that NAMES have.
NAMES_SHARE = 0.1
#: Alphabets of usual keys, and how many strings of how many
#: characters are drawn from each.
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
DRAWN, DRAWN_LENGTHS = 1500, (10, 48)
HELD_OUT, MOST_FALSE, LEAST_RATIO = 5, 0.0005, 9.0
#: Counts that a context gets from the next shorter one.
LEAN = 30.0
#: Width of the bins in which held-out ratios are counted.
BIN = 0.25

#: A character's symbol: 0 outside tokens, letters without case, digits, signs.
_SYMBOLS = "\0abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(_SYMBOLS)
SYMBOL = np.zeros(256, np.int64)
for _i, _c in enumerate(_SYMBOLS):
    SYMBOL[ord(_c)] = SYMBOL[ord(_c.upper())] = _i
LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
CAPITAL = np.array([65 <= c <= 90 for c in range(256)])
#: Class of a character: outside, small letter, capital, digit, sign.
CLASS = np.zeros(256, np.int64)
CLASS[[ord(c) for c in _SYMBOLS[1:27]]], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[ord(c) for c in "+/_=-"]] = 4
#: Steps of a model: triples of symbols, then pairs of classes with 0 or 1.
TRIPLES, CASES = N ** 3, 25 * 2

Span = tuple[int, int, int, int, int]  # start, kind, end, secret's start and end


def base_spans(text: str) -> list[Span]:
    found = []
    for kind, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end(), m.start(group), m.end(group)))
    return sorted(found)


def drawn(seed: int = 20_240_229) -> list[str]:
    """Random strings, evenly drawn from each of ALPHABETS."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(*DRAWN_LENGTHS)))
            for letters in ALPHABETS for _ in range(DRAWN // len(ALPHABETS))]


def held_out(token: str) -> bool:
    return zlib.crc32(token.encode()) % HELD_OUT == 0


def steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: the triple and the class pair with case of each step,
    whether it is a letter's, and where each token's steps begin."""
    b = np.frombuffer("".join(f"\0\0{t}" for t in tokens).encode(), np.uint8)
    s, c = SYMBOL[b], CLASS[b]
    inside = np.flatnonzero(s)
    triple = (s[inside - 2] * N + s[inside - 1]) * N + s[inside]
    case = (c[inside - 2] * 5 + c[inside - 1]) * 2 + CAPITAL[b[inside]]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))[:-1]
    return triple, case, LETTER[b[inside]], starts


def counted(tokens: list[str], out: np.ndarray) -> None:
    """Adds the steps of the tokens to ``out`` (TRIPLES + CASES counts)."""
    if tokens:
        triple, case, letter, _ = steps(tokens)
        np.add.at(out, triple, 1)
        np.add.at(out, TRIPLES + case[letter], 1)


def chances(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log chances of a character after two others, and of its case."""
    three = counts[:TRIPLES].reshape(N, N, N).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    even = np.full(N, 1 / (N - 1))
    even[0] = 0
    c1 = (one + LEAN * even) / (one.sum() + LEAN)
    c2 = (two + LEAN * c1) / (two.sum(1, keepdims=True) + LEAN)
    c3 = (three + LEAN * c2) / (three.sum(2, keepdims=True) + LEAN)
    case = counts[TRIPLES:].reshape(25, 2).astype(float)
    with np.errstate(divide="ignore"):
        return np.log(c3), np.log((case + 1) / (case.sum(1, keepdims=True) + 2))


def samples(text: str) -> tuple[set[str], set[str]]:
    """The labelled strings of a text: ordinary tokens and secrets."""
    spans = sorted(base_spans(text), key=lambda s: s[0])
    secret = {t for s in spans for t in TOKEN.findall(text[s[3]:s[4]])}
    at, rest = 0, []
    for start, _, end, _, _ in spans:
        rest.append(text[at:max(at, start)])
        at = max(at, end)
    return set(TOKEN.findall("\n".join([*rest, text[at:]]))) - secret, secret


def _samples(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[bool, str]]:
        for batch in found:
            for text in texts(batch.column(0)):
                ordinary, secret = samples(text)
                for kind, tokens in ((False, ordinary), (True, secret)):
                    for t in tokens:
                        yield kind, t
    yield from batches(rows(), pa.schema([("secret", pa.bool_()), ("token", pa.string())]))


def _sums(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(secret, step, n) of the strings that train."""
    counts = np.zeros((2, TRIPLES + CASES), np.int64)
    for batch in found:
        kinds, tokens = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for kind in (False, True):
            counted([t for k, t in zip(kinds, tokens, strict=True) if k == kind and not held_out(t)], counts[int(kind)])
    kind, step = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(bool)), pa.array(step.astype(np.int32)),
                                      pa.array(counts[kind, step])], names=["secret", "step", "n"])


class Ratio:
    """Log ratio of a step's chances in random strings and in ordinary ones,
    the limit, and the error rates on the held-out strings."""

    def __init__(self, ordinary: np.ndarray, random: np.ndarray):
        (a3, a1), (b3, b1) = chances(ordinary), chances(random)
        self.char = np.zeros((N, N, N), np.float32)
        self.char[:, :, 1:] = b3[:, :, 1:] - a3[:, :, 1:]  # no step leads outside
        self.char, self.case = self.char.ravel(), (b1 - a1).astype(np.float32).ravel()
        self.limit, self.false_rate, self.missed_rate, self.held = LEAST_RATIO, 0.0, 0.0, (0, 0)

    def of(self, tokens: list[str]) -> np.ndarray:
        """The ratio of each token; none for tokens of an ordinary shape."""
        if not tokens:
            return np.empty(0)
        triple, case, letter, starts = steps(tokens)
        each = self.char[triple] + np.where(letter, self.case[case], 0)
        out = np.add.reduceat(each.astype(np.float64), starts)
        out[[ORDINARY.fullmatch(t) is not None for t in tokens]] = -np.inf
        return out

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Tokens that look random, apart from ``taken`` spans."""
        places = [m.span() for m in TOKEN.finditer(text)]
        hit = self.of([text[a:b] for a, b in places]) >= self.limit
        return [(a, len(KINDS) - 1, b, a, b) for (a, b), x in zip(places, hit.tolist(), strict=True)
                if x and not any(s[0] < b and a < s[2] for s in taken)]


def _binned(shared: object) -> Callable:
    """(secret, bin, n): held-out strings by the bin of their ratio."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in found:
            rows = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    if held_out(t)]
            at = np.floor(np.clip(shared.value.of([t for _, t in rows]), -100, 1000) / BIN)
            counts.update(zip((k for k, _ in rows), at.astype(int).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in counts], pa.bool_()), pa.array([b for _, b in counts], pa.int32()),
             pa.array(counts.values(), pa.int64())], names=["secret", "bin", "n"])
    return run


def train(docs: DataFrame) -> Ratio:
    """The two models and the limit, from all documents. What reaches the
    driver: two tables of step counts and two histograms of ratios."""
    tokens = docs.select(id_and_text(docs)[1]).mapInArrow(_samples, "secret boolean, token string") \
        .groupBy("secret", "token").agg(F.count("*").alias("n")).filter("secret or n > 1")
    tokens = stage(tokens.select("secret", "token"), "tokens")
    found = tokens.mapInArrow(_sums, "secret boolean, step int, n long") \
        .groupBy("secret", "step").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, TRIPLES + CASES))
    counts[found.column("secret").to_numpy().astype(int), found.column("step").to_numpy()] = found.column("n").to_numpy()
    names, random = np.zeros((2, TRIPLES + CASES), np.int64)
    counted(NAMES, names)
    counted([t for t in drawn() if not held_out(t)], random)
    weight = max(1.0, counts[0, :TRIPLES].sum() * NAMES_SHARE / (1 - NAMES_SHARE) / names[:TRIPLES].sum())
    ratio = Ratio(counts[0] + weight * names, counts[1] + random)
    bins = tokens.mapInArrow(_binned(docs.sparkSession.sparkContext.broadcast(ratio)), "secret boolean, bin int, n long") \
        .groupBy("secret", "bin").agg(F.sum("n").alias("n")).collect()
    false = sorted(((r.bin, r.n) for r in bins if not r.secret), reverse=True)
    held, reached = sum(n for _, n in false), 0
    for at, n in false:
        if (reached + n) > MOST_FALSE * held or (at + 1) * BIN <= LEAST_RATIO:
            break
        reached += n
    else:
        at = 0
    ratio.limit = max(LEAST_RATIO, (at + 1) * BIN if false else 0)
    own = [x for x in drawn() if held_out(x)]
    secret = [(r.bin * BIN, r.n) for r in bins if r.secret] + [(x, 1) for x in ratio.of(own).tolist()]
    ratio.held = held, sum(n for _, n in secret)
    ratio.false_rate = sum(n for at, n in false if at * BIN >= ratio.limit) / max(1, held)
    ratio.missed_rate = sum(n for x, n in secret if x < ratio.limit) / max(1, ratio.held[1])
    return ratio


def _all_spans(ratio: Ratio, text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + ratio.spans(text, base))


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans)


def scan(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """One row per document: doc_id, counts per base kind, the digest of the
    base spans and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # two tables of fixed size, 300 KB
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:3]],
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(found: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in found:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                base, spans = _all_spans(model, text)
                yield (doc_id, *[sum(s[1] == k for s in base) for k in range(3)],
                       hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans))

    return docs.select(*id_and_text(docs)).mapInArrow(
        lambda found: batches(rows(found), schema),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, ratio: Ratio, mark: str = "[REDACTED]", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with the secret part of every span replaced
    by ``mark``; ``length_col`` follows the changed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(text: str | None, model: Ratio) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, _, _, a, b in sorted(_all_spans(model, text)[1], key=lambda s: (s[3], -s[4])):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if at else text

    def run(found: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in found:
            old = batch.column(place).to_pylist()
            new = [clean(t, model) for t in old]
            changed = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
            if changed:
                columns = list(batch.columns)
                columns[place] = pa.array(new, columns[place].type)
                if length is not None:
                    sizes = columns[length].to_pylist()
                    for i in changed:
                        sizes[i] = len(new[i])
                    columns[length] = pa.array(sizes, columns[length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, train(docs))
