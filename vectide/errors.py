"""The error of a violated contract."""


class ContractError(ValueError):
    """An input or a request breaks a stated rule."""
