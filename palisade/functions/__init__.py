"""Part of palisade; see the README."""
