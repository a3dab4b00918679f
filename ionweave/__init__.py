"""Part of the ionweave spectrum analytics engine."""
