"""Named queries; importing the package fills the registry."""

from . import queries, pages, shapes, text, images, documents, places, more  # noqa: F401, I001  (the others add to what queries begins)
