"""Plain Python versions of the operators, for small inputs."""

import base64
import hashlib
import re
from collections import defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, sha(t)))
    return out


def windows(items, size=10):
    found = defaultdict(set)
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        k = min(size, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            found[tuple(w[s:s + k])].add(item)
    return found


def leaks(rows, items):
    wins = windows(items)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        hit, got = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in wins:
                    hit.update(range(s, s + k))
                    got |= {str(x) for x in wins[tuple(w[s:s + k])] if x is not None}
        out.append((i, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    pairs = {(a, b) for ks in by.values() for n, a in enumerate(ks) for b in ks[n + 1:]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    comp = defaultdict(list)
    for k in range(len(rows)):
        comp[find(k)].append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in comp[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c, i == c))
    return out


def repeats(rows, length=100):
    """Rows in the operator's order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def encoder():
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(rows):
    enc, out = encoder(), []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(enc.decode_bytes(ids))))
    return out


def lz_phrases(text, block):
    """The phrase set, by slices and a restart at each block."""
    out = set()
    for at in range(0, len(text), block):
        piece, known, start = text[at:at + block], set(), 0
        for end in range(1, len(piece) + 1):
            if piece[start:end] not in known:
                known.add(piece[start:end])
                start = end
        out |= known
    return out


def falling(rows, tie):
    """Documents by falling id, null ids last; equal ids by ``tie``, then text."""
    rows = [(i, t or "") for i, t in rows]
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]], r[1]))


def edited(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def damaged(rows):
    """conv -> rows (turn, role, text) after damage, in order."""
    import zlib
    gap = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{gap(conv)}:{gap(turn)}".encode()) % 20
        role, text = gap(role), gap(text)
        here = out[conv]
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repairs(rows):
    """(cost, audit, turns): the cheapest, least repair over whole strings, one per pair of
    (automaton text so far reduced to its last initial and whether it is empty)."""
    def step(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    def insert(cells):
        out = dict(cells)
        for _ in range(4):
            for q, (cost, audit, turns) in list(out.items()):
                for role in ("user", "assistant"):
                    to = step(q, role[0])
                    if to:
                        cand = (cost + 2, audit + "I", turns + [(role, "")])
                        if to not in out or cand[:2] < out[to][:2]:
                            out[to] = cand
        return out

    cells = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(to, cand):
            if to is not None and (to not in new or cand[:2] < new[to][:2]):
                new[to] = cand

        for q, (cost, audit, turns) in insert(cells).items():
            offer(q, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                offer(step(q, role[:1]), (cost + cut, audit + "K", turns + [(role, text)]))
                for to in ("user", "assistant"):
                    offer(step(q, to[0]), (cost + 2 + cut, audit + "R", turns + [(to, text)]))
        cells = new
    return min((c for q, c in insert(cells).items() if q in ("", "a")), key=lambda c: c[:2])


def repaired(rows):
    out = []
    by = damaged(rows)
    for conv in {r[0] for r in rows}:
        here = by.get(conv, [])
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = faults(here)
        initials = [r[:1] for _, r, _ in here]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = repairs(here)
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
                    sha("\n".join(f"{r}:{t}" for r, t in fixed))))
    return out


def aligned(rows):
    """Both tokenizers' own libraries, every pair of ranges compared by a walk."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars, k = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            chars[chr(b)] = b
        else:
            chars[chr(k)] = b
            k += 1

    def cuts(text):
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(chars[c] for c in tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in map(sp.id_to_piece, b)]
        want = (" " + text).encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            return [], []
        out = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, side = 0, []
            for i, x in zip(ids, raw):
                side.append((i, at, at + len(x)))
                at += len(x)
            out.append(side)
        return out

    docs, count = [], defaultdict(int)
    for i, t in rows:
        a, b = cuts(t or "")
        links, y = [], 0
        for x, (ia, s, e) in enumerate(a):
            while b[y][2] <= s:
                y += 1
            z = y
            while z < len(b) and b[z][1] < e:
                links.append((ia, b[z][0]))
                z += 1
        for p in set(links):
            count[p] += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        place = {e: k for k, e in enumerate(ends)}
        groups = [([], []) for _ in ends]
        for k, side in enumerate((a, b)):
            g = 0
            for token, _, e in side:
                groups[g][k].append(str(token))
                g += e in place
        groups = ["|".join(map(",".join, g)) for g in groups]
        docs.append((i, len(a), len(b), len(ends), links, ";".join(groups)))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(i, na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha(g) if na else "")
            for i, na, nb, ng, links, g in docs]
