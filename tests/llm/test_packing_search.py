"""Sizes on which best fit misses the bound: the islands' search must come out ahead of it, and stay a packing."""

import random

import pytest

from ledgerlight.llm.packing import CAPACITY, GENERATIONS, POPULATION, Packer

# half of the sizes above a third of a sequence: few fit together well
HARD = (0.25, 0.5, 600)


@pytest.mark.parametrize("seed", range(6))
def test_the_search_beats_best_fit(seed):
    low, high, n = HARD
    sizes = [random.Random(seed * 1000 + k).randint(int(low * CAPACITY), int(high * CAPACITY)) for k in range(n)]
    packer = Packer(sizes, CAPACITY, seed)
    population = packer.first(POPULATION)
    found = packer.evolve(population, GENERATIONS)[0]
    assert sorted(i for b in found for i in b) == list(range(n))
    assert max(map(packer.fill, found)) <= CAPACITY
    assert packer.least <= len(found) < len(population[0])


def test_nothing_is_searched_where_best_fit_meets_the_bound():
    packer = Packer([1024] * 10 + [512] * 8, CAPACITY, 1)
    population = packer.first(POPULATION)
    assert len(population[0]) == packer.least
    before = packer.random.getstate()
    assert len(packer.evolve(population, GENERATIONS)[0]) == packer.least and packer.random.getstate() == before
