import random
from collections import defaultdict

from careflow.llm.chat import (
    END, FAR, INSERT, KEEP, MERGE, RELABEL, ROLES, START, STEPS, UNKNOWN, actions, chain, format_chats, role_of, walk,
)


def least(roles):
    """Cheapest repair by trying everything."""

    def rest(i, state):
        if i == len(roles):
            return END[state][0]
        return min((cost + rest(i + 1, new) for new, cost, _, _ in STEPS[state, roles[i]]), default=FAR)

    return rest(0, START)


def legal(roles):
    body = roles[1:] if roles[:1] == [0] else roles
    return len(body) > 1 and len(body) % 2 == 0 and all(r == 1 + i % 2 for i, r in enumerate(body))


def test_chained_parts_are_optimal_and_legal():
    for seed in range(400):
        rng = random.Random(seed)
        roles = [rng.choice([-1, 0, 1, 1, 2, 2]) for _ in range(rng.randint(1, 6))]
        cuts = sorted({0, len(roles), *(rng.randint(0, len(roles)) for _ in range(2))})
        parts = [roles[a:b] for a, b in zip(cuts, cuts[1:])]
        matrices = []
        for part in parts:
            m = {"costs": {}, "turns": {}, "n": len(part)}
            for e in range(4):
                m["costs"][e], m["turns"][e] = zip(*walk(part, e)[-1])
            matrices.append(m)
        out, cost, position = [], 0, 0
        for part, (entry, leave, before, last) in zip(parts, chain(matrices)):
            assert before == position
            for role, (new, action, inserted) in zip(part, actions(part, entry, leave)):
                out += inserted
                position += len(inserted) + 1
                if action != "merge":
                    out.append(new)
                cost += INSERT * len(inserted) + (MERGE if action == "merge" else KEEP if new == role else UNKNOWN if role < 0 else RELABEL)
            if last:
                out += END[leave][1]
                cost += END[leave][0]
        assert legal(out) and cost == least(roles)


def test_conversations_over_several_partitions(spark):
    long = [(1, i, ["user", "user", "assistant", "x"][i * 7 % 4], f"t{i}") for i in range(3000)]
    odd = [(None, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "a"), (2, 1, "system", "s"), (2, 2, "GPT", None), (3, 1, "assistant", "")]
    table = spark.createDataFrame([(*r, "x") for r in long + odd], "conv_id long, turn long, role string, text string, position string")
    got = defaultdict(list)
    for r in format_chats(table).collect():
        got[r.conv_id].append(r)
    assert set(got) == {1, 2, 3, None}
    for conv, rows in got.items():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        given = sorted((r for r in long + odd if r[0] == conv), key=lambda r: tuple((v is not None, v) for v in r))
        assert [r.turn for r in rows if r.action != "insert"] == [r[1] for r in given]
        text = "".join(r.rendered for r in rows)
        assert legal([ROLES.index(part.split("\n")[0]) for part in text.split("<|im_start|>")[1:]])
        assert text.count("<|im_end|>\n") == text.count("<|im_start|>") and text.endswith("<|im_end|>\n")
    assert "".join(r.rendered for r in got[2]) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert format_chats(table.limit(0)).count() == 0


def test_roles():
    assert [role_of(r) for r in ("User", " human ", "gpt", "system", None, "tool")] == [1, 1, 2, 0, -1, -1]
