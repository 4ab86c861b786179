"""Errors of the image codecs."""


class CodecError(ValueError):
    """What goes wrong with an image file."""


class FormatError(CodecError):
    """The bytes aren't what the format asks for."""


class UnsupportedError(CodecError):
    """A valid feature that isn't supported."""


class InternalError(CodecError):
    """A fault of the codec itself."""
