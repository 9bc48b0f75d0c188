"""Mining in memory, a plain loop over all pairs, to hold the tables' result against."""

import json

from arborlake.functions.merging import abstracted
from arborlake.plans import mining


def mine_by_hand(rows, least=0.0):
    """{id: (row, parent, instances)} of the forest over template rows, by the rounds that mining.mine describes."""
    live: dict[str, dict] = {}
    for r in rows:
        key = "o" + json.dumps([r[c] for c in mining.SAME])
        live.setdefault(key, {"row": r, "t": mining.load_template(r), "n": 0})["n"] += 1
    found = {k: dict(v) for k, v in live.items()}
    parent: dict[str, str] = {}
    stuck: dict[tuple, int] = {}
    names = {}
    order = lambda k: names.setdefault(k, k)
    while True:
        blocks: dict[tuple, list[str]] = {}
        for k, v in live.items():
            blocks.setdefault((v["row"]["action"], v["row"]["block"]), []).append(k)
        changed = False
        for block, own in sorted(blocks.items()):
            todo = first_groups(block, own, live, stuck.get(block, 0))
            if todo is None:
                continue
            changed = True
            number, step, free, groups = todo
            new = []
            for group in groups:
                best = {}
                for a in group:
                    best[a] = min((-mining.step_score(step, live[a]["t"], live[b]["t"]), live[b]["key"], b) for b in group if b != a)
                for a in group:
                    b = best[a][2]
                    if best[b][2] == a and live[a]["key"] < live[b]["key"] and (not free or -best[a][0] >= least):
                        new.append((step, a, b))
            moved = False
            for step, a, b in new:
                made = abstracted(step, live[a]["t"], live[b]["t"])
                made_rows = [mining.template_row(t) for t in made]
                for k, child in enumerate((a, b)):
                    r = made_rows[min(k, len(made) - 1)]
                    if len(made) > 1 and all(r[c] == live[child]["row"][c] for c in mining.SAME[2:]):
                        continue
                    moved = True
                    name = made_name(step, live[a]["key"], live[b]["key"], k if len(made) > 1 else "")
                    n = live[child]["n"] if len(made) > 1 else live[a]["n"] + live[b]["n"]
                    found[name] = {"row": r, "t": mining.load_template(r), "n": n, "key": name}
                    parent[child] = name
            for _, a, b in new:
                for child in (a, b):
                    if child in parent:
                        live.pop(child, None)
                        live[parent[child]] = found[parent[child]]
            if moved:
                stuck.pop(block, None)
            else:
                stuck[block] = number
            put_together([k for k, v in live.items() if (v["row"]["action"], v["row"]["block"]) == block], live, found, parent)
        if not changed:
            return {k: (found[k]["row"], parent.get(k), found[k]["n"]) for k in found}


def made_name(step, a, b, k):
    import hashlib

    return "t" + hashlib.blake2b(f"{step} {a} {b} {k}".encode(), digest_size=12).hexdigest()


def first_groups(block, own, live, after):
    for v in live.values():
        if "key" not in v:
            import hashlib

            v["key"] = "o" + hashlib.md5("~".join(v["row"][c] for c in mining.SAME).encode()).hexdigest()
    for number, step, actions, key in sorted(mining.STEPS, key=lambda s: s[0]):
        if number <= after or actions is not None and block[0] not in actions:
            continue
        groups: dict[tuple, list[str]] = {}
        for k in own:
            if step != "within" or live[k]["row"]["within"] is not None:
                groups.setdefault(tuple(live[k]["row"][c] for c in key), []).append(k)
        groups = [g for g in groups.values() if len(g) > 1]
        if groups:
            return number, step, key in mining.FREE, groups
    return None


def put_together(own, live, found, parent):
    same: dict[tuple, list[str]] = {}
    for k in own:
        same.setdefault(tuple(live[k]["row"][c] for c in mining.SAME), []).append(k)
    for group in same.values():
        if len(group) > 1:
            rep = min(group, key=lambda k: live[k]["key"])
            total = sum(live[k]["n"] for k in group)
            for k in group:
                if k != rep:
                    for child, p in list(parent.items()):
                        if p == k:
                            parent[child] = rep
                    live.pop(k)
                    found.pop(k)
            live[rep]["n"] = found[rep]["n"] = total


def forest_rows(rows):
    """The forest as rows of training.FOREST_SCHEMA."""
    return [{"template_id": k, "parent_id": p, "action": r["action"], "instances": n, **{s: r[s] for s in mining.SIDES}, "places": r["places"]} for k, (r, p, n) in mine_by_hand(rows).items()]


def outline(forest):
    """Nodes with their parents, by content: (action, sides, instances, the parent's sides)."""
    rows = {r["template_id"]: r for r in forest}
    content = lambda x: None if x is None else json.dumps([[n[c] for c in ("dfs", "last", "role", "kind", "type", "value", "vtype")] for n in json.loads(x)])
    sides = lambda r: None if r is None else tuple(content(r[s]) for s in mining.SIDES)
    return sorted(((r["action"], sides(r), r["instances"], sides(rows.get(r["parent_id"]))) for r in forest), key=repr)

