"""What a task leaves behind in its Python worker, which Spark keeps for the tasks of any other stage."""

import ctypes
import gc
from functools import wraps

import pyarrow as pa


def give_back():
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(generator):
    """A generator function that gives memory back when its task is done with it."""
    @wraps(generator)
    def run(*args):
        try:
            yield from generator(*args)
        finally:
            give_back()

    return run
