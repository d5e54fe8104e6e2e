import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


class Groups:
    """Union-find for brute-force components."""

    def __init__(self, items):
        self.root = {i: i for i in items}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


@pytest.fixture(scope="session")
def groups():
    return Groups
