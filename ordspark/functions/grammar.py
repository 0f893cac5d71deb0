"""Case-government rules as column expressions.

``candidates`` are the readings of a word by rank, as entries (lemma, pos,
gcase, …); ``before``/``after`` are its neighbours' entries, null when unknown.
A rule gives a struct (lemma, pos, rule, confidence) or null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import resources as R

# Endings that tell a definite noun's case, tried in this order.
SUFFIX_CASES = (
    (r"(unum|inum|inni|inu)$", ("þgf",)),
    (r"(innar|nna|ins)$", ("ef",)),
    (r"(inn|ið|nar|nir)$", ("nf", "þf")),
    (r"(ina)$", ("þf",)),
)
NO_CASES = "array<string>"


def infer_case(word: Column) -> Column:
    """Cases that a word's ending allows; an empty array if it tells nothing."""
    low = F.lower(word)
    found = reduce(lambda acc, x: acc.when(low.rlike(x[0]), F.array(*map(F.lit, x[1]))), SUFFIX_CASES[1:], F.when(low.rlike(SUFFIX_CASES[0][0]), F.array(F.lit("þgf"))))
    return found.otherwise(F.array().cast(NO_CASES))


def governed_cases(preposition: Column) -> Column:
    """Cases a preposition governs, null for any other word."""
    table = F.create_map(*[x for k, v in R.PREPOSITION_CASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, F.lower(preposition))


def is_preposition(word: Column) -> Column:
    return F.lower(word).isin(*R.PREPOSITION_CASES)


def can_govern(preposition: Column, case: Column) -> Column:
    return F.coalesce(F.array_contains(governed_cases(preposition), case), F.lit(False))


def _of(entries: Column, *pos: str) -> Column:
    return F.filter(entries, lambda e: e.pos.isin(*pos))


def _any(entries: Column, test) -> Column:
    return F.coalesce(F.exists(entries, test), F.lit(False))


def _match(lemma: Column, pos: str, rule: Column, confidence: float) -> Column:
    return F.struct(lemma.alias("lemma"), F.lit(pos).alias("pos"), rule.alias("rule"), F.lit(confidence).alias("confidence"))


def _verb(candidates: Column) -> Column:
    verbs = _of(candidates, "so")
    return F.when(_any(verbs, lambda e: e.lemma == "eiga"), F.lit("eiga")).otherwise(F.get(verbs, F.lit(0)).lemma)


def subject_verb(candidates: Column, prev_word: Column, before: Column, next_word: Column, after: Column) -> Column:
    """A nominative subject before and a noun phrase that is not dative only after: the verb."""
    suffix, case = infer_case(next_word), lambda test: _any(after, test)
    dative, other = case(lambda e: e.gcase == "þgf"), case(lambda e: e.gcase.isNotNull() & (e.gcase != "þgf"))
    noun = _any(after, lambda e: e.pos == "no")
    told = dative | other
    has_dative = F.when(told, dative).otherwise(F.coalesce(F.array_contains(suffix, "þgf"), F.lit(False)))
    bare = F.coalesce(F.size(suffix) == 0, F.lit(True))
    has_other = F.when(told, other).otherwise((~bare & ~F.array_contains(suffix, "þgf")) | (F.size(suffix) > 1) | (bare & noun))
    phrase = noun | _any(after, lambda e: e.pos.isin("lo", "to"))
    prev_suffix, prev_verb = infer_case(prev_word), _any(before, lambda e: e.pos == "so")
    nominative = _any(before, lambda e: (e.gcase == "nf") & e.pos.isin("no", "fn")) | F.array_contains(prev_suffix, "nf") | ((F.size(prev_suffix) == 0) & ~prev_verb)
    ok = prev_word.isNotNull() & _any(candidates, lambda e: e.pos == "so") & _any(candidates, lambda e: e.pos == "fs") & ~(has_dative & ~has_other) & phrase & _any(before, lambda e: e.pos == "no") & nominative
    return F.when(F.coalesce(ok, F.lit(False)), _match(_verb(candidates), "so", F.lit("subject+verb+obj"), 0.85))


def preposition(candidates: Column, after: Column) -> Column:
    """A preposition reading whose case the next word can have."""
    pairs = F.flatten(F.transform(_of(candidates, "fs"), lambda c: F.transform(F.filter(after, lambda e: can_govern(c.lemma, e.gcase)), lambda e: F.struct(c.lemma.alias("lemma"), e.gcase.alias("gcase")))))
    first = F.get(pairs, F.lit(0))
    return F.when(F.coalesce(F.size(pairs) > 0, F.lit(False)), _match(first.lemma, "fs", F.concat(F.lit("prep+"), first.gcase), 0.9))


def noun_after_preposition(candidates: Column, prev_word: Column, before: Column) -> Column:
    """The first noun reading in a case that the preceding preposition governs."""
    prep = F.get(_of(before, "fs"), F.lit(0)).lemma
    unclear = _any(before, lambda e: e.pos == "fn") & _any(candidates, lambda e: e.pos == "so")
    nouns = F.filter(candidates, lambda e: (e.pos == "no") & can_govern(prep, e.gcase))
    first = F.get(nouns, F.lit(0))
    ok = prev_word.isNotNull() & prep.isNotNull() & ~unclear & (F.size(nouns) > 0)
    return F.when(F.coalesce(ok, F.lit(False)), _match(first.lemma, "no", F.concat(F.lit("noun_after_prep+"), first.gcase), 0.9))


def pronoun_verb(candidates: Column, prev_word: Column) -> Column:
    """After a nominative pronoun a word that can be a verb, among other things, is one."""
    ok = F.lower(prev_word).isin(*R.NOMINATIVE_PRONOUNS) & _any(candidates, lambda e: e.pos == "so") & _any(candidates, lambda e: e.pos != "so")
    return F.when(F.coalesce(ok, F.lit(False)), _match(_verb(candidates), "so", F.lit("pronoun+verb"), 0.85))


def grammar(candidates: Column, prev_word: Column, before: Column, next_word: Column, after: Column) -> Column:
    """The first rule that applies."""
    return F.coalesce(subject_verb(candidates, prev_word, before, next_word, after), preposition(candidates, after), noun_after_preposition(candidates, prev_word, before), pronoun_verb(candidates, prev_word))


def rules_for(word: Column) -> Column:
    """Array of the preference rules of a word, in order; empty if it has none or is null."""
    rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("word", "prefer", "over", "context"), rule)]) for rule in R.DISAMBIGUATION_RULES])
    return F.filter(rules, lambda r: F.coalesce(r.word == F.lower(word), F.lit(False)))


def has_rules(word: Column) -> Column:
    return F.coalesce(F.lower(word).isin(*sorted({rule[0] for rule in R.DISAMBIGUATION_RULES})), F.lit(False))


def preference(candidates: Column, prev_word: Column, next_word: Column, rules=R.DISAMBIGUATION_RULES) -> Column:
    """The first preference rule whose two readings exist and whose context holds."""
    contexts = {
        "before_noun": next_word.rlike("^[A-ZÁÉÍÓÚÝÞÆÖ]"),
        "before_verb": next_word.isNotNull() & ~F.lower(next_word).isin(*R.DETERMINERS),
        "after_pronoun": F.lower(prev_word).isin(*R.NOMINATIVE_PRONOUNS),
    }
    out = []
    for word, prefer, over, context in rules:
        if context in contexts:  # the others never hold
            has = lambda pos, word=word: _any(candidates, lambda e: (F.lower(e.lemma) == word) & (e.pos == pos))
            out.append(F.when(F.coalesce(has(prefer) & has(over) & contexts[context], F.lit(False)), F.struct(F.lit(word).alias("lemma"), F.lit(prefer).alias("pos"), F.lit(0.85).alias("confidence"))))
    return F.coalesce(*out)
