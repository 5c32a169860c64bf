"""A semi-Markov conditional random field over tokens of short windows: whole-span features, bounded segments.

A segment is 1 to MAX_TOKENS tokens with a type, every other token is outside with score 0. The score of a segment is
the sum of its features' weights for its type. `fit` maximises the conditional likelihood of segmentations of made
sentences (`SENTENCES` of them, from a seed), in which templates plant spans and look-alikes that are none; it reads no
table, so the weights are the same for every corpus. `decode` chooses boundaries and types jointly. Both take time
linear in the number of tokens.
"""

import math
import random
import re
from functools import lru_cache

import numpy as np

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TYPES = ("secret", "phone", "account", "birth")
MAX_TOKENS = 16
SENTENCES = 400
EDGES = "\"'`.,;:<>[]{}|“”«»"
# Words that announce a span, in four languages.
BEFORE = {
    "secret": r"(?:password|passwd|passphrase|pwd|secret|token|api[ _-]?key|key|contraseña|clave|passwort|kennwort|mot de passe)",
    "phone": r"(?:phone|telephone|tel|call|mobile|fax|telefon|handy|teléfono|móvil|téléphone|portable)",
    "account": r"(?:iban|account|account (?:number|no)|konto|kontonummer|cuenta|compte|passport|passport (?:number|no)|passeport|pasaporte|reisepass)",
    "birth": r"(?:born|born on|birth|birthday|birthdate|dob|geboren|geboren am|geburtsdatum|née? le|nacid[oa] el|fecha de nacimiento)",
}
AFTER = {k: re.compile(rf"(?i)(?<![^\W_]){v}(?: (?:is|was|ist|es|est))?(\W{{1,4}})\Z") for k, v in BEFORE.items()}
KEYED = re.compile(rf"(?i)(?<![^\W_]){BEFORE['secret']}(?: (?:is|was|ist|es|est))?\W{{1,4}}")
STEMS = ("pass", "pwd", "secret", "token", "key", "contrase", "clave", "kennwort")  # one is in each word for a secret
SHAPES = {"iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), "us": re.compile(r"\(?\d{3}\)?[ .-] ?\d{3}[ .-]\d{4}"), "pairs": re.compile(r"0\d(?:[ .-]\d\d){4}"), "trunk": re.compile(r"0\d{2,4}[ /-]?\d{5,8}"),
          "date": re.compile(r"(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)\d\d|(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"), "letters_number": re.compile(r"[A-Z]{1,2}\d{6,8}"), "number": re.compile(r"\d+"), "hex": re.compile(r"[0-9a-f]{16,}"),
          "prefix": re.compile(r"(?:AKIA[A-Z0-9]{16}|[a-z]{2}_[a-z]{4}_[A-Za-z0-9]{16,})")}


def iban_holds(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def bucket(n, bounds):
    return sum(n >= b for b in bounds)


def features(text, a, b, n):
    """Names of what is true of text[a:b], a span of n tokens; None if it can be no span."""
    s = text[a:b]
    if s[0] in EDGES or s[-1] in EDGES:
        return None
    digits = sum("0" <= c <= "9" for c in s)
    before = text[max(0, a - 40):a]
    said = {k: m.group(1) for k, r in AFTER.items() if (m := r.search(before))}
    if digits < 6 and "secret" not in said and not SHAPES["prefix"].fullmatch(s):
        return None
    letters = sum(c.isalpha() for c in s)
    out = ["bias", f"digits{bucket(digits, (1, 6, 8, 9, 10, 12, 16))}", f"letters{bucket(letters, (1, 3, 6, 9, 16))}", f"tokens{bucket(n, (2, 3, 4, 6, 9, 12))}"]
    for k, sep in said.items():
        out += [f"after_{k}", f"after_{k}_{'mark' if any(c in '=:' for c in sep) else 'plain'}"]
    if any(c.isspace() for c in s):
        out += ["space", "space_and_no_digit_word" if any(not any(c.isdigit() for c in w) for w in s.split()) else "space_in_numbers"]
    else:
        near = a > 0 and not text[a - 1].isspace() and text[a - 1] not in EDGES + "=(", b < len(text) and not text[b].isspace() and text[b] not in EDGES + ")#!?"
        out += [f for f, on in zip(("cut_left", "cut_right"), near) if on]
    if letters and digits:
        out.append("mixed")
    if any(c in "#\n\t" for c in s):
        out.append("odd")
    for name, r in SHAPES.items():
        if r.fullmatch(s):
            out.append(f"is_{name}")
            if name == "iban":
                out.append("iban_holds" if iban_holds(s) else "iban_fails")
    for k in said:  # shapes count more where the words before announce them
        out += [f"{f}_after_{k}" for f in out if f.startswith("is_")]
    return out


def candidates(text, tokens, free):
    """(i, j, features) of all segments tokens[i:j] that can be a span: of free tokens, with six digits in numbers of two
    digits on average, or after a word that announces a secret, or with the prefix of a key."""
    if not tokens:
        return
    digits = np.array([sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens])
    total, numbers, taken = (np.concatenate([[0], np.cumsum(x)]) for x in (digits, digits > 0, ~np.array(free, bool)))
    opens = np.zeros(len(tokens), bool)
    low, ends = text[tokens[0][0]:tokens[-1][1]].lower(), set()
    if any(w in low or w in text[max(0, tokens[0][0] - 40):tokens[0][0]].lower() for w in STEMS):
        ends = {m.end() for m in KEYED.finditer(text, max(0, tokens[0][0] - 40), tokens[-1][1])}
        ends |= {e - back for e in ends for back in (1, 2, 3)}  # a mark may belong to the span
    for i, (a, b) in enumerate(tokens):
        opens[i] = a in ends or text.startswith("AKIA", a) or b - a == 2 and text.startswith("_", b)
    found = []
    for n in range(1, min(MAX_TOKENS, len(tokens)) + 1):
        d, k = total[n:] - total[:-n], numbers[n:] - numbers[:-n]
        start = np.nonzero((taken[n:] == taken[:-n]) & ((d >= 6) & (d >= 2 * k) | opens[:len(d)]))[0]
        found += [(int(i), int(i) + n) for i in start]
    for i, j in sorted(found):
        f = features(text, tokens[i][0], tokens[j - 1][1], j - i)
        if f:
            yield i, j, f


def decode(text, tokens, free, weights):
    """The best segmentation's spans (start, end, type)."""
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    ends = {}
    for i, j, f in candidates(text, tokens, free):
        score, kind = max((sum(w.get(x, 0.0) for x in f), k) for k, w in weights.items())
        if score > 0:
            ends.setdefault(j, []).append((i, score, kind))
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, score, kind in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], len(tokens)
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def made(rng, kind):
    """(words before, span, is it one) of a template."""
    pick, some = rng.choice, lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if kind == "secret":
        head = pick(["password=", "password: ", "token = ", "token: ", "secret is ", "api_key: ", "api key = ", "passwort: ", "mot de passe : ", "contraseña: ", "key=", "pwd "])
        value = pick([some("0123456789abcdef", pick([32, 40])), some(low + up + num, rng.randint(20, 40)), some(up, 1) + some(low, 4) + some(num, 1) + some(low, 3) + pick("&!?$%") + some(num, 2), some(low, 5) + some(num, 3), some(low, rng.randint(7, 12)) if head.strip()[-1] in "=:" else some(low, 6) + some(num, 2)])
        bare = pick([f"AKIA{some(up + num, 16)}", f"sk_live_{some(low + up + num, 24)}"])
        return (head, value, True) if rng.random() < 0.75 else ("", bare, True)
    if kind == "phone":
        us = f"{some(num, 3)}{{}}{some(num, 3)}{pick('-.')}{some(num, 4)}"
        value = pick([us.format(pick("-. ")), f"({some(num, 3)}) {some(num, 3)}-{some(num, 4)}", "0" + some("123456789", 1) + "".join(f" {some(num, 2)}" for _ in range(4)), f"0{some(num, 3)} {some(num, 7)}", f"0{some(num, 9)}"])
        return pick(["call ", "phone: ", "tel. ", "telefon ", "teléfono: ", "mobile ", "portable : "] + ["the "] * (2 * ("(" in value or len(value) == 12 and value[3] in "-."))), value, True
    if kind == "account":
        body = some(num, pick([14, 18, 20]))
        country = some(up, 2)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        iban = f"{country}{check:02d}{body}"
        if rng.random() < 0.5:
            iban = " ".join(iban[i:i + 4] for i in range(0, len(iban), 4))
        if rng.random() < 0.5:
            return pick(["iban ", "IBAN: ", "", "konto "]), iban, True
        return pick([("account number ", some(num, rng.randint(8, 12))), ("account: ", some(num, rng.randint(8, 12))), ("cuenta ", some(num, 10)), ("passport ", some(up, pick([1, 2])) + some(num, 7)), ("passport no: ", some(up, 1) + some(num, 8)), ("reisepass ", some(up, 1) + some(num, 8))]) + (True,)
    day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1930, 2015)
    date = pick([f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d}", f"{day}/{month}/{year}"])
    if kind == "birth":
        return pick(["born ", "born on ", "dob: ", "birthday: ", "geboren am ", "né le ", "nacida el "]), date, True
    return pick([("on ", date), ("the ", some(num, 16)), ("number ", some(num, rng.randint(6, 14))), ("version ", "2.0"), ("in ", str(year)), ("commit ", some("0123456789abcdef", 40)), ("price ", f"{some(num, 3)}.{some(num, 2)}"), ("the key is ", some(low, 6)), ("a token of ", some(low, 8)), ("secret ", some(low, 7)), ("of ", f"{some(up, 2)}{some(num, 18)}"),
                 ("from ", f"{year}-{year + 3}"), ("order ", f"{some(num, 8)}-{some(num, 3)}"), ("see ", f"{some(num, 3)}, {some(num, 4)} and {some(num, 3)}"), ("pages ", f"{some(num, 3)} {some(num, 4)} {some(num, 2)}"), ("time ", f"{year}{month:02d}{day:02d}T{some(num, 6)}"), ("url ", f"https://a.example/{some(num, 9)}"), ("the key: ", pick(["the ", "a "]) + some(low, 6))]) + (False,)


def sentence(rng):
    """(text, spans) of made words with one to three planted spans or look-alikes."""
    word = lambda: "".join(rng.choice("aeioulmnrstdé") for _ in range(rng.randint(2, 9)))
    text, spans = " ".join(word() for _ in range(rng.randint(1, 5))) + " ", []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([*TYPES, "none", "none", "none"])
        head, value, real = made(rng, kind)
        left, right = rng.choice([("", ""), ("", ""), ("", "."), ("", ","), ('"', '"'), ('"', '"###'), ("", "###"), ("'", "'")])
        at = len(text) + len(head) + len(left)
        text += head + left + value + right + " " + " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ". "])
        if real:
            spans.append((at, at + len(value), kind))
    return text, spans


def logsum(a, b):
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


@lru_cache(maxsize=4)
def fit(sentences: int = SENTENCES, seed: int = 8, rounds: int = 8, rate: float = 0.3, decay: float = 1e-4):
    """{type: {feature: weight}} by stochastic gradient steps (AdaGrad) on the log-likelihood of the segmentations."""
    rng, data = random.Random(seed), []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segments = list(candidates(text, tokens, [True] * len(tokens)))
        gold = {(a, b): k for a, b, k in spans}
        truth = {(i, j): gold[tokens[i][0], tokens[j - 1][1]] for i, j, _ in segments if (tokens[i][0], tokens[j - 1][1]) in gold}
        data.append((len(tokens), segments, truth))
    weights = {k: {} for k in TYPES}
    squares = {k: {} for k in TYPES}
    for _ in range(rounds):
        rng.shuffle(data)
        for n, segments, truth in data:
            scores = [[sum(weights[k].get(x, 0.0) for x in f) for k in TYPES] for _, _, f in segments]
            into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for s, (i, j, _) in enumerate(segments):
                into[j].append(s)
                out_of[i].append(s)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1]
                for s in into[j]:
                    for v in scores[s]:
                        alpha[j] = logsum(alpha[j], alpha[segments[s][0]] + v)
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1]
                for s in out_of[i]:
                    for v in scores[s]:
                        beta[i] = logsum(beta[i], beta[segments[s][1]] + v)
            step = {}
            for (i, j, f), vs in zip(segments, scores):
                for k, v in zip(TYPES, vs):
                    g = (truth.get((i, j)) == k) - math.exp(min(0.0, alpha[i] + v + beta[j] - alpha[n]))
                    if abs(g) > 1e-3:
                        for x in f:
                            step[k, x] = step.get((k, x), 0.0) + g
            for (k, x), g in step.items():
                g -= decay * weights[k].get(x, 0.0)
                squares[k][x] = squares[k].get(x, 1e-6) + g * g
                weights[k][x] = weights[k].get(x, 0.0) + rate * g / math.sqrt(squares[k][x])
    return weights
