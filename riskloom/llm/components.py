"""Connected components; kept under this name for the operators that link documents."""

from riskloom.operators.stars import components  # noqa: F401
