"""Runs of chunks against a plain version of the rules."""

import random

from paperloom.operators import attempts


def plain(targets, reusable, kept, salvaged, written, log, max_repairs):
    if reusable:
        return ("reuse", 0, 0, 0, "reused", None, None, None)
    known = [t for t in targets if t in kept or t in salvaged]
    left = [t for t in targets if t not in known]
    path = ["salvage"] if any(t in targets and t not in kept for t in salvaged) else []
    log, count, last = list(log), 0, None

    def ask(kind, asked):
        """The outcome of a request, and what is left; None where the log ends."""
        nonlocal left, count, last
        path.append(kind)
        if not log:
            return None
        outcome, accepted = log.pop(0)
        left = [t for t in left if t not in asked or t not in accepted]
        count, last = count + 1, outcome
        return "done" if outcome == "ok" else "repair" if outcome in ("output_shape", "validation_failed", "invalid_json", "schema_mismatch") else "stop" if outcome in attempts.STOPS else "split"

    def waiting(kind, asked):
        return (">".join(path), count, len(known), len(left), "open", kind, asked, None)

    if left:
        kind, asked = ("resume", left) if known or written else ("initial", targets)
        after = ask(kind, asked)
        if after is None:
            return waiting(kind, asked)
        repairs = 0
        while after == "repair" and repairs < max_repairs and left:
            asked = left
            after = ask("repair", asked)
            if after is None:
                return waiting("repair", asked)
            repairs += 1
        if after != "stop" and left:
            half = (len(left) + 1) // 2
            for piece in [p for p in (left[:half], left[half:]) if p]:
                after = ask("split", piece)
                if after is None:
                    return waiting("split", piece)
                if after == "stop":
                    break
    path.append("save")
    code = None
    if left:
        code = {"ok": "chunk_validation", "validation_failed": "chunk_validation", "output_shape": "chunk_output_shape"}.get(last, f"llm_{last}")
    return (">".join(path), count, len(known), len(left), "failed" if left else "complete", None, None, code)


def test_runs(spark):
    rng = random.Random(11)
    outcomes = ["ok", "validation_failed", "output_shape", "invalid_json", "timeout", "quota", "validation_failed"]
    for max_repairs in (0, 1, 2):
        chunks, log, want = [], [], {}
        for k in range(300):
            targets = list(range(rng.randrange(1, 8)))
            some = lambda share: [t for t in range(9) if rng.random() < share]
            kept, salvaged = some(0.2) if rng.random() < 0.3 else [], some(0.3) if rng.random() < 0.3 else []
            row = (targets, rng.random() < 0.1, kept, salvaged, bool(salvaged) or rng.random() < 0.1)
            own = [(n, rng.choice(outcomes), some(rng.choice([0.2, 0.6, 1]))) for n in sorted(rng.sample(range(50), rng.choice([0, 1, 2, 3, 6, 9])))]
            chunks.append((k, *row))
            log += [(k, *a) for a in own]
            want[k] = plain(*row, [a[1:] for a in own], max_repairs)
        rng.shuffle(log)
        got = attempts.runs(
            spark.createDataFrame(chunks, "k long, targets array<long>, reusable boolean, kept array<long>, salvaged array<long>, written boolean"),
            spark.createDataFrame(log, "k long, number int, outcome string, accepted array<long>"), "k", max_repairs,
        )
        assert got.columns == ["k", "path", "requests", "recovered", "left", "status", "next", "targets", "code"]
        assert {r.k: tuple(r)[1:] for r in got.collect()} == want
        steps = {s for w in want.values() for s in w[0].split(">")}
        assert steps == {"reuse", "salvage", "initial", "resume", "split", "save"} | ({"repair"} if max_repairs else set())
        assert {w[4] for w in want.values()} == {"reused", "complete", "failed", "open"}
