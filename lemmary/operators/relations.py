"""Relations between the predicates of a sentence.

Each relation is an array expression over the sentence's predicates: what would be
a chain of joins on (sentence, variable) stays inside the row, so extraction runs
without any exchange until triples are counted. Greedy rules (a combination of
lemmas counts once per sentence) fold over candidates in traversal order.

A predicate hooks on a variable if its lemma is the lemma of some predicate with
that variable in the slot: words of one lemma in a sentence are not told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.sources.logical_form import NO_POS

NONE, ABSENT, LARGEST_SET = "<NONE>", "<->", 4

Relation = Callable[[Column], Column]


def of_pos(preds: Column, pos: str) -> Column:
    return F.filter(preds, lambda p: p["pos"] == pos)


def of_extra(preds: Column, name: str) -> Column:
    return F.filter(preds, lambda p: p["extra"] == name)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an array result, with the value computed once. Lambda bodies
    are interpreted, and an expression written twice in one is computed twice."""
    return F.flatten(F.transform(F.array(value), use))


def hook(preds: Column, variable: Column, slot: int, pos: str) -> Column:
    """Predicates of a part of speech whose lemma has ``variable`` in the slot."""
    held = F.transform(F.filter(preds, lambda q: q[f"a{slot}"] == variable), lambda q: q["lemma"])
    # an absent variable compares as NULL and holds nothing
    return let(F.array_compact(held), lambda h: F.filter(preds, lambda p: (p["pos"] == pos) & F.array_contains(h, p["lemma"])))


def lemma_set(preds: Column, pos: str) -> Column:
    """``lemma&&lemma-POS`` of at most four predicates, NULL for none or more."""
    text = lambda held: F.concat(F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda p: p["lemma"]))), "&&"), F.lit("-" + pos))
    return F.get(F.transform(F.array(preds), lambda held: F.when(F.size(held).between(1, LARGEST_SET), text(held))), F.lit(0))


def hook_set(preds: Column, variable: Column, slot: int, pos: str) -> Column:
    return lemma_set(hook(preds, variable, slot, pos), pos)


def word(p: Column) -> Column:
    """``lemma-POS``; predicates that are no word print as such."""
    return F.concat(F.coalesce(p["lemma"], F.lit("None")), F.lit("-"), F.coalesce(p["pos"], F.lit(NO_POS)))


def emit(*args: Column) -> Column:
    """A triple's arguments; NULL becomes ``<NONE>``."""
    return F.array(*[F.coalesce(a, F.lit(NONE)) for a in args])


def each(items: Column, make: Callable[[Column], Column]) -> Column:
    """Flat map."""
    return F.flatten(F.transform(items, make))


def only(condition: Column, value: Column) -> Column:
    """``[value]`` if the condition holds, else ``[]``."""
    return F.filter(F.array(value), lambda _: F.coalesce(condition, F.lit(False)))


def differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def together(*words: Column) -> Column:
    """A key of lemmas in any order."""
    return F.array_join(F.array_sort(F.array(*words)), "")


def first_wins(candidates: Column) -> Column:
    """``triple`` of candidates ``struct<key, triple>`` whose key was not seen before."""
    unique = lambda cs: F.filter(cs, lambda c, i: F.array_position(F.transform(cs, lambda d: d["key"]), c["key"]) == i + 1)
    return F.transform(let(candidates, unique), lambda c: c["triple"])


def with_set(preds: Column, variable: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the noun set on a variable's second slot; nothing if there is none."""
    return F.flatten(F.transform(F.array_compact(F.array(hook_set(preds, variable, 2, "NN"))), use))


def with_subject(preds: Column, verb: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a verb's subject set, NULL if there is none."""
    return let(hook_set(preds, verb["a2"], 2, "NN"), use)


def keyed(key: Column, triple: Column) -> Column:
    return F.struct(key.alias("key"), triple.alias("triple"))


def _subj_verb_obj(slot: str) -> Relation:
    def relation(preds: Column) -> Column:
        def match(v: Column) -> Column:
            return with_set(preds, v[slot], lambda obj: with_subject(preds, v, lambda subj: only(differ(subj, obj), emit(subj, word(v), obj))))

        return each(of_pos(preds, "VB"), match)

    return relation


def subj_verb_instr(preds: Column) -> Column:
    def match(v: Column) -> Column:
        def with_instr(i: Column) -> Column:
            return with_set(preds, i["a3"], lambda noun: with_subject(preds, v, lambda subj: only(differ(subj, noun), emit(subj, word(v), noun))))

        return each(F.filter(of_extra(preds, "instr"), lambda i: i["a2"] == v["a1"]), with_instr)

    return each(of_pos(preds, "VB"), match)


def subj_verb(preds: Column) -> Column:
    def match(v: Column) -> Column:
        return with_set(preds, v["a2"], lambda subj: F.array(emit(subj, word(v))))

    return each(F.filter(preds, lambda p: (p["pos"] == "VB") & p["a3"].isNull() & p["a4"].isNull()), match)


def subj_verb_prep_compl(preds: Column) -> Column:
    """The attached word may be any predicate, also one that is no word."""

    def match(v: Column) -> Column:
        def attached(q: Column) -> Column:
            return with_set(preds, q["a3"], lambda noun: with_subject(preds, v, lambda subj: only(differ(subj, noun), emit(subj, word(v), word(q), noun))))

        return each(F.filter(preds, lambda q: q["a2"] == v["a1"]), attached)

    return each(F.filter(preds, lambda p: (p["pos"] == "VB") & p["a2"].isNotNull()), match)


def _verb_pairs(preds: Column, make: Callable[[Column, Column], Column]) -> Column:
    def match(v: Column) -> Column:
        others = F.filter(hook(preds, v["a3"], 1, "VB"), lambda w: w["ppos"] != v["ppos"])
        return F.transform(others, lambda w: make(v, w))

    return each(of_pos(preds, "VB"), match)


def subj_verb_verb_prep_noun(preds: Column) -> Column:
    """The first pair of verb lemmas that emits does so for all its prepositions."""

    def pair(v: Column, w: Column) -> Column:
        def attached(p: Column) -> Column:
            return with_set(preds, p["a3"], lambda noun: with_subject(preds, v, lambda subj: only(differ(subj, noun), emit(subj, word(v), word(w), word(p), noun))))

        return keyed(together(v["lemma"], w["lemma"]), each(hook(preds, w["a1"], 2, "PREP"), attached))

    emitting = F.filter(_verb_pairs(preds, pair), lambda c: F.size(c["triple"]) > 0)
    return F.flatten(first_wins(emitting))


def subj_verb_verb(preds: Column) -> Column:
    """No preposition may hang on the first verb."""

    def pair(v: Column, w: Column) -> Column:
        free = F.size(hook(preds, v["a1"], 2, "PREP")) == 0
        return let(hook_set(preds, v["a2"], 2, "NN"), lambda subj: only(free & subj.isNotNull(), keyed(together(v["lemma"], w["lemma"]), emit(subj, word(v), word(w)))))

    return first_wins(F.flatten(_verb_pairs(preds, pair)))


def _no_prep(preds: Column, variable: Column, *slots: int) -> Column:
    return reduce(lambda a, b: a & b, [F.size(hook(preds, variable, s, "PREP")) == 0 for s in slots])


def noun_adj(preds: Column) -> Column:
    def match(a: Column) -> Column:
        return with_set(preds, a["a2"], lambda noun: only(_no_prep(preds, a["a2"], 2, 3), emit(noun, word(a))))

    return each(of_pos(preds, "ADJ"), match)


def noun_verb_adv(preds: Column) -> Column:
    def match(r: Column) -> Column:
        verbs = F.filter(hook(preds, r["a2"], 1, "VB"), lambda _: _no_prep(preds, r["a1"], 2, 3))
        return F.transform(verbs, lambda v: emit(hook_set(preds, v["a2"], 2, "NN"), word(v), word(r)))

    return each(of_pos(preds, "RB"), match)


def _compound(size: int) -> Relation:
    """Nouns that share their variable with ``size - 1`` others and no preposition."""

    def relation(preds: Column) -> Column:
        def match(n: Column) -> Column:
            def with_others(others: Column) -> Column:
                members = [n, *[F.get(others, F.lit(i)) for i in range(size - 1)]]
                lemmas = F.array(*[m["lemma"] for m in members])
                fits = (F.size(others) == size - 1) & (F.size(F.array_distinct(lemmas)) == size)
                return only(fits & _no_prep(preds, n["a2"], 2), keyed(together(*[m["lemma"] for m in members]), emit(*[word(m) for m in members])))

            return let(F.filter(hook(preds, n["a2"], 2, "NN"), lambda o: o["ppos"] != n["ppos"]), with_others)

        return first_wins(each(of_pos(preds, "NN"), match))

    return relation


def noun_equal_prep_noun(preds: Column) -> Column:
    """Pairs of the three nouns are used once; the pair of the first two is only
    looked at before its prepositions, so one pair may emit for several of them."""

    def equal(q: Column) -> Column:
        def first(n1: Column) -> Column:
            def second(n2: Column) -> Column:
                def prep(p: Column) -> Column:
                    third = F.filter(hook(preds, p["a3"], 2, "NN"), lambda n3: (n3["ppos"] != n1["ppos"]) & (n3["ppos"] != n2["ppos"]))
                    return F.transform(
                        third,
                        lambda n3: F.struct(together(n1["lemma"], n3["lemma"]).alias("k2"), together(n2["lemma"], n3["lemma"]).alias("k3"), emit(word(n1), word(n2), word(p), word(n3)).alias("triple")),
                    )

                return F.struct(together(n1["lemma"], n2["lemma"]).alias("k1"), each(hook(preds, n2["a2"], 2, "PREP"), prep).alias("found"))

            others = F.filter(hook(preds, q["a3"], 2, "NN"), lambda n2: n2["ppos"] != n1["ppos"])
            return F.transform(others, second)

        return each(hook(preds, q["a2"], 2, "NN"), first)

    strings, rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    start = F.struct(strings.alias("k1"), strings.alias("k2"), strings.alias("k3"), rows.alias("out"))
    push = lambda xs, x: F.concat(xs, F.array(x))

    def take(state: Column, c: Column) -> Column:
        new = ~F.array_contains(state["k2"], c["k2"]) & ~F.array_contains(state["k3"], c["k3"])
        grown = F.struct(state["k1"].alias("k1"), push(state["k2"], c["k2"]).alias("k2"), push(state["k3"], c["k3"]).alias("k3"), push(state["out"], c["triple"]).alias("out"))
        return F.when(new, grown).otherwise(state)

    def pair(state: Column, c: Column) -> Column:
        after = F.aggregate(c["found"], state, take)
        emitted = F.size(after["out"]) > F.size(state["out"])
        marked = F.struct(F.when(emitted, push(after["k1"], c["k1"])).otherwise(after["k1"]).alias("k1"), after["k2"].alias("k2"), after["k3"].alias("k3"), after["out"].alias("out"))
        return F.when(F.array_contains(state["k1"], c["k1"]), state).otherwise(marked)

    return F.aggregate(each(of_extra(preds, "equal"), equal), start, pair, lambda s: s["out"])


def noun_equal_noun(preds: Column) -> Column:
    def match(q: Column) -> Column:
        return with_set(preds, q["a2"], lambda a: with_set(preds, q["a3"], lambda b: only((a != b) & _no_prep(preds, q["a3"], 2), emit(a, b))))

    return each(of_extra(preds, "equal"), match)


def noun_prep_noun(preds: Column) -> Column:
    def match(p: Column) -> Column:
        def first(n1: Column) -> Column:
            others = F.filter(hook(preds, p["a3"], 2, "NN"), lambda n2: n2["ppos"] != n1["ppos"])
            return F.transform(others, lambda n2: keyed(together(n1["lemma"], n2["lemma"]), emit(word(n1), word(p), word(n2))))

        return each(hook(preds, p["a2"], 2, "NN"), first)

    return first_wins(each(of_pos(preds, "PREP"), match))


def compl(preds: Column) -> Column:
    def side(x: Column) -> Column:
        words = F.concat(*[F.transform(hook(preds, x, 1, pos), word) for pos in ("VB", "RB")])
        sets = F.array(*[hook_set(preds, x, slot, pos) for slot in (1, 2) for pos in ("NN", "ADJ")])
        return F.concat(words, F.array_compact(sets))

    return each(of_extra(preds, "compl"), lambda c: each(side(c["a2"]), lambda a: F.transform(side(c["a3"]), lambda b: emit(a, b))))


def nn_prep(preds: Column) -> Column:
    def match(p: Column) -> Column:
        return with_set(preds, p["a2"], lambda a: with_set(preds, p["a3"], lambda b: only(a != b, emit(a, word(p), b))))

    return each(of_pos(preds, "PREP"), match)


def noun_adj_prep_noun(preds: Column) -> Column:
    """The preposition may stand anywhere in the sentence."""

    def match(a: Column) -> Column:
        def first(n1: Column) -> Column:
            def prep(p: Column) -> Column:
                others = F.filter(hook(preds, p["a3"], 2, "NN"), lambda n2: n2["ppos"] != n1["ppos"])
                return F.transform(others, lambda n2: emit(word(n1), word(a), word(p), word(n2)))

            return each(of_pos(preds, "PREP"), prep)

        return each(hook(preds, a["a2"], 2, "NN"), first)

    return each(of_pos(preds, "ADJ"), match)


#: The active relations; more can be given to :func:`extract_triples`.
ACTIVE: dict[str, Relation] = {
    "subj_verb_dirobj": _subj_verb_obj("a3"),
    "subj_verb_indirobj": _subj_verb_obj("a4"),
    "subj_verb_instr": subj_verb_instr,
    "subj_verb": subj_verb,
    "subj_verb_prep_compl": subj_verb_prep_compl,
    "subj_verb_verb_prep_noun": subj_verb_verb_prep_noun,
    "subj_verb_verb": subj_verb_verb,
    "noun_adj": noun_adj,
    "noun_verb_adv": noun_verb_adv,
    "noun_equal_prep_noun": noun_equal_prep_noun,
    "nn": _compound(2),
    "nnn": _compound(3),
    "noun_equal_noun": noun_equal_noun,
    "noun_prep_noun": noun_prep_noun,
    "compl": compl,
}

INACTIVE: dict[str, Relation] = {"nn_prep": nn_prep, "noun_adj_prep_noun": noun_adj_prep_noun}


#: What a sentence must hold for a relation to be looked for: parts of speech, and
#: names of predicates without lemma in brackets.
NEEDS: dict[str, tuple[str, ...]] = {
    "subj_verb_dirobj": ("VB", "NN"),
    "subj_verb_indirobj": ("VB", "NN"),
    "subj_verb_instr": ("VB", "NN", "(instr)"),
    "subj_verb": ("VB", "NN"),
    "subj_verb_prep_compl": ("VB", "NN"),
    "subj_verb_verb_prep_noun": ("VB", "PREP", "NN"),
    "subj_verb_verb": ("VB", "NN"),
    "noun_adj": ("NN", "ADJ"),
    "noun_verb_adv": ("RB", "VB"),
    "noun_equal_prep_noun": ("(equal)", "PREP", "NN"),
    "nn": ("NN",),
    "nnn": ("NN",),
    "noun_equal_noun": ("(equal)", "NN"),
    "noun_prep_noun": ("PREP", "NN"),
    "compl": ("(compl)",),
    "nn_prep": ("PREP", "NN"),
    "noun_adj_prep_noun": ("ADJ", "PREP", "NN"),
}


def held(preds: Column) -> Column:
    """The parts of speech and names of a sentence's predicates, as in ``NEEDS``."""
    return F.array_distinct(F.transform(preds, lambda p: F.coalesce(p["pos"], F.concat(F.lit("("), p["extra"], F.lit(")")))))


def _where_held(name: str, relation: Relation, tags: Column) -> Column:
    """Matches of a relation; nothing is tried where the sentence lacks what it needs."""
    found = relation(F.col("preds"))
    needs = NEEDS.get(name, ()) if relation is {**ACTIVE, **INACTIVE}.get(name) else ()
    return F.when(reduce(lambda a, b: a & b, [F.array_contains(tags, n) for n in needs]), found) if needs else found


def extract_relation(parsed: DataFrame, name: str, relation: Relation | None = None) -> DataFrame:
    """``file, sid, rel, arg1 .. arg5`` of one relation, a row per match."""
    relation = relation or {**ACTIVE, **INACTIVE}[name]
    tagged = parsed.select("file", "sid", "preds", held(F.col("preds")).alias("tags"))
    matched = tagged.select("file", "sid", F.explode(_where_held(name, relation, F.col("tags"))).alias("args"))
    return matched.select("file", "sid", F.lit(name).alias("rel"), *[F.coalesce(F.get("args", F.lit(i)), F.lit(ABSENT)).alias(f"arg{i + 1}") for i in range(5)])


def extract_triples(parsed: DataFrame, relations: dict[str, Relation] | None = None) -> DataFrame:
    """All matches of all relations in one pass over the sentences."""
    relations = ACTIVE if relations is None else relations
    if not relations:
        raise ValueError("no relation given")
    tagged = parsed.select("file", "sid", "preds", held(F.col("preds")).alias("tags"))
    found = F.array(*[F.struct(F.lit(name).alias("rel"), _where_held(name, r, F.col("tags")).alias("matches")) for name, r in relations.items()])
    matched = tagged.select("file", "sid", F.inline(found)).select("file", "sid", "rel", F.explode("matches").alias("args"))
    return matched.select("file", "sid", "rel", *[F.coalesce(F.get("args", F.lit(i)), F.lit(ABSENT)).alias(f"arg{i + 1}") for i in range(5)])


def fold_triples(triples: DataFrame) -> DataFrame:
    """``rel, arg1 .. arg5, freq``: how often each triple was matched."""
    return triples.groupBy("rel", *[f"arg{i}" for i in range(1, 6)]).agg(F.count("*").alias("freq"))


def reduce_counts(counted: DataFrame, key: list[str], count_col: str = "freq") -> DataFrame:
    """Sums of partial counts."""
    return counted.groupBy(*key).agg(F.sum(count_col).alias(count_col))
