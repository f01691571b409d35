"""What the groups of features of the credential scorer do, on files with known secrets: python tests/llm/ablation.py

Trained on weak labels of one half of the files, counted on the lines of the other half.
"""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_credentials import corpus  # noqa: E402

from engrama.llm import credentials as C  # noqa: E402

GROUPS = {
    "identifiers (key words in the key and before it)": [1, 2, 3, 4, 5],
    "issuer's prefix": [6],
    "kind of place": [7, *range(8, 8 + len(C.CONTEXTS))],
    "shape of the value": [*range(8 + len(C.CONTEXTS), C.REFERENCE_AT), C.REFERENCE_AT + 1],
    "path": [C.REFERENCE_AT + 2, C.REFERENCE_AT + 3, C.REFERENCE_AT + 4],
    "Markov likelihood": [C.N_FEATURES - 1],
}


def rows(files):
    chain = np.full((C.ALPHABET, C.ALPHABET), 0.5)
    for _, _, text, *_ in files:
        s = C._symbols(text)
        np.add.at(chain, (s[:-1], s[1:]), 1)
    chain = np.log(chain / chain.sum(axis=1, keepdims=True))
    for i, path, text, *_ in files:
        for c in C.candidates(text, path):
            x = C.features(c, path.rsplit(".", 1)[-1], path)
            yield i, text.count("\n", 0, c.spans[0][0]) + 1, c, [*x, -C.likelihood(chain, c.value) / 5], C.weak_label(c, x)


def main() -> None:
    files, truth = corpus(random.Random(7), 2000)
    found = list(rows(files))
    x = np.array([r[3] for r in found])
    label = np.array([r[4] for r in found])
    train = np.array([r[0] % 4 < 2 for r in found])
    wanted = {t for t in truth if t[0] % 4 >= 2}

    def count(columns, taught, veto=True):
        at = np.isin(np.arange(x.shape[1]), columns)
        fit = train & (label >= 0) & taught
        w = C.fit_logistic(x[fit] * at, label[fit].astype(float))
        p = 1 / (1 + np.exp(-np.clip((x * at) @ w, -30, 30)))
        if veto:
            p[x[:, C.REFERENCE_AT] > 0] = 0
        got = {(r[0], r[1]) for r, q, t in zip(found, p, train) if q >= C.THRESHOLD and not t}
        return len(got & wanted) / max(1, len(got)), len(got & wanted) / len(wanted)

    every, none = list(range(x.shape[1])), np.ones(len(x), bool)
    print(f"lines {len(wanted)}, precision and recall")
    print("all features: %.3f %.3f" % count(every, none))
    print("all, references not excluded: %.3f %.3f" % count([k for k in every if k != C.REFERENCE_AT], none, False))
    for name, columns in GROUPS.items():
        print("without %s: %.3f %.3f" % (name, *count([k for k in every if k not in columns], none)))
        print("only %s: %.3f %.3f" % (name, *count([0, *columns], none)))
    for name, kind in (("tokens with an issuer's prefix", [bool(C.PREFIXED.fullmatch(r[2].value)) for r in found]), ("logins in addresses", [r[2].context == "login" for r in found]), ("comparisons and calls", [r[2].context in ("compare", "call") for r in found])):
        kind = np.array(kind)
        at = {(r[0], r[1]) for r, k, t in zip(found, kind, train) if k and not t} & wanted
        fit = train & (label >= 0) & ~kind
        w = C.fit_logistic(x[fit], label[fit].astype(float))
        got = {(r[0], r[1]) for r, q in zip(found, x @ w > 0) if q}
        print(f"no labels of {name}: recall of their lines {len(got & at) / max(1, len(at)):.3f} of {len(at)}")


if __name__ == "__main__":
    main()
