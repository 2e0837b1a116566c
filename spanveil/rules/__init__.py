"""Rules are data: what the detectors, gates and overlays look for, apart from how it is run."""
