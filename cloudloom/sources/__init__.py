"""Where points, frames and records come from."""
