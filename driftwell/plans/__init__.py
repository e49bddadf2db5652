"""Planning of compactions, and the engine that carries them out."""
