import pytest


@pytest.fixture(scope="session")
def rows_of():
    """The rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
