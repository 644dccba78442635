"""Change messages as streams, and jobs that apply requests as they arrive."""
